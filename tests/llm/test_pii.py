import pytest

from vellumine.llm.pii import card_holds, checked, find_personal, find_spans, iban_holds, luhn, mod11_10, redact


def found(text):
    return [(k, text[a:b]) for k, a, b, _ in find_spans(text)]


@pytest.mark.parametrize("text,want", [
    ("Write to <a.moor+x@mail.example.org>.", [("email", "a.moor+x@mail.example.org")]),
    ("mailto:ben_n@uni-x.test now", [("email", "ben_n@uni-x.test")]),
    ("reach c.orr [at] uni [dot] test or d(at)lab.example", [("email", "c.orr [at] uni [dot] test"), ("email", "d(at)lab.example")]),
    ("E AT uni DOT example", [("email", "E AT uni DOT example")]),
    ("broken ann@\nuni.test here", [("email", "ann@\nuni.test")]),
    ("firm@year effects, tag @some_lab", []),
    ("Tel. +44 (0)20 7946 0271", [("phone", "+44 (0)20 7946 0271")]),
    ("call (212) 555 - 0185 ext. 13 or 07700 900123, 01.99.00.12.34", [("phone", "(212) 555 - 0185"), ("phone", "07700 900123"), ("phone", "01.99.00.12.34")]),
    ("Lot numbers 09 20 93 30 13 to 095 13 77 5 26 were withdrawn", []),
    ("ISSN 2004-0700, doi:10.9999/ab.2015.3052, Grant 1983-070-66, report no. 95602-41", []),
    ("shows SSN 962742872 and passport no. X4492662", [("id_number", "962742872"), ("id_number", "X4492662")]),
    ("NI number QQ 58 59 59 C", [("id_number", "QQ 58 59 59 C")]),
    ("SSN: 913 80 2647;+44 20 7946 0127.", [("id_number", "913 80 2647"), ("phone", "+44 20 7946 0127")]),
    ("at Flat 14, 204 Vuleph Gardens\nValaland", [("address", "Flat 14, 204 Vuleph Gardens")]),
    ("mailed to 41, rue des Flesold, 00060 Elwick", [("address", "41, rue des Flesold")]),
    ("Calle de Jalross, 14, 2º A", [("address", "Calle de Jalross, 14")]),
    ("letters go to Plaarnstraße 87b, 00099 C", [("address", "Plaarnstraße 87b")]),
    ("route 33 and the Ostvemann Avenue district", []),
    ("We thank Ada B. Moor and Dr. Nash for comments", [("name", "Ada B. Moor"), ("name", "Nash")]),
    ("Correspondence: van der Orr, Ben, b@x.test", [("name", "van der Orr, Ben"), ("email", "b@x.test")]),
    ("El expediente de Pike, Cyr incluye Passport ZZ563676.", [("name", "Pike, Cyr"), ("id_number", "ZZ563676")]),
    ("Moor (2011) and Nash et al. (2001) disagree; the Moor Foundation and Orr & Sons do not.", []),
    ("signed\nDr. Moor\nCalle del Skaold, 9, 6º B\n020 7946 0270 Ada van der Orr joined us", [("name", "Moor"), ("address", "Calle del Skaold, 9"), ("phone", "020 7946 0270"), ("name", "Ada van der Orr")]),
    ("NI number QQ 13 86 76 C. Ben H. Nash joined. Version 3.3. Call 1-808-555-0179", [("id_number", "QQ 13 86 76 C"), ("name", "Ben H. Nash"), ("phone", "1-808-555-0179")]),
    ("Contact: Prof. Tate, DORA.TATE@UNI.TEST", [("name", "Tate"), ("email", "DORA.TATE@UNI.TEST")]),
    ("# Policy Implications\n\nThe Valaland reform", []),
])
def test_spans(text, want):
    assert found(text) == want


def test_checks():
    assert luhn("79927398713") and not luhn("79927398710")
    assert checked("X1234567L") and not checked("X1234567A")
    assert checked("811228-9874")


@pytest.mark.parametrize("text,holds,fails", [
    ("The form says {} and nothing else.", "12345678Z", "12345678A"),
    ("Entry {} was copied.", "811228-9874", "811228-9873"),
    ("Entry {} was copied.", "86095742719", "86095742718"),
    ("Seen on the sheet: {}.", "123-45-6789", "923-45-6789"),
    ("Seen on the sheet: {}.", "2 55 08 14 168 025 38", "2 55 08 14 168 025 39"),
    ("The DNI that we were given is {}.", "12345678Z", "12345678A"),
])
def test_only_the_check_decides(text, holds, fails):
    assert found(text.format(holds)) == [("id_number", holds)]
    assert not [k for k, _ in found(text.format(fails)) if k == "id_number"]


def test_a_check_ranks_a_labelled_number():
    score = lambda t: find_spans(t)[0][3]
    assert score("DNI 12345678Z") > score("passport no. X4492662") > score("DNI 12345678A")
    assert found("The passport number given there is X4492662.") == [("id_number", "X4492662")]
    assert found("(X4492662, his passport number)") == [("id_number", "X4492662")]
    assert not found("Lot 811228-9874 and sample 12345678Z were kept; grant 123-45-6789 ended.")


def test_cards_and_accounts():
    assert found("Paid with 4111 1111 1111 1111 today") == [("card", "4111 1111 1111 1111")]
    assert not [k for k, _ in found("Paid with 4111 1111 1111 1112 today") if k == "card"]
    assert found("to DE89 3704 0044 0532 0130 00, please") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert found("to GB29NWBK60161331926819.") == [("iban", "GB29NWBK60161331926819")]
    assert not [k for k, _ in found("to DE88 3704 0044 0532 0130 00, please") if k == "iban"]
    assert card_holds("3782 822463 10005") and iban_holds("DE89 3704 0044 0532 0130 00") and mod11_10("86095742719")


@pytest.mark.parametrize("text,want", [  # sentences with cues that no list names
    ("Maria Gonzales visited the archive yesterday.", ["Maria Gonzales"]),
    ("The parcel was left for Tomás Herrera at the desk.", ["Tomás Herrera"]),
    ("It was then that Joan Oakes met Piotr Zielinski.", ["Joan Oakes", "Piotr Zielinski"]),
    ("Anke Petersen wohnte damals in der Stadt.", ["Anke Petersen"]),
    ("Luc Moreau travaillait au musée.", ["Luc Moreau"]),
    ("Pilar Quintana llegó tarde.", ["Pilar Quintana"]),
    ("Patent Applications increased in 2004. Energy Policy changed, and policy matters.", []),
    ("Technology Transfer was slow; Regional Innovation declined.", []),
])
def test_names_by_shape_and_general_context(text, want):
    assert [x for k, x in found(text) if k == "name"] == want


def test_rows(spark):
    text = "😀 Dr. Ada Moor, a@b.test"
    rows = [(1, text), (2, None), (3, ""), (None, text), (1, text), (4, "nothing here " * 20_000 + text)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, kind string")
    out = find_personal(df).collect()
    assert len(out) == 8 and {(r.kind, r.char_start) for r in out if r.doc_id == 1} == {("name", 6), ("email", 16)}
    clean = {r.doc_id: r.redacted for r in redact(df).filter("doc_id < 4").collect()}
    assert clean == {1: "😀 Dr. [NAME], [EMAIL]", 2: None, 3: ""}
    assert find_personal(df.limit(0)).count() == 0
