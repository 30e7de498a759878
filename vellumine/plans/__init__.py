"""Query registries over the engine's operators."""


def core_registries() -> list:
    from vellumine.plans.analysis import analysis
    from vellumine.plans.chunking import chunking
    from vellumine.plans.files import files
    from vellumine.plans.pipeline import pipeline
    from vellumine.plans.records import records
    from vellumine.plans.retrieval import retrieval
    from vellumine.plans.service import service
    from vellumine.plans.text import text

    return [records, text, chunking, retrieval, analysis, files, service, pipeline]
