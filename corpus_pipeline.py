"""The corpus pipeline: quality rules, toxicity, near duplicates, decontamination, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes it as Parquet in the shared
folder and reads it again as the next stage's documents. Ids of `documents` are unique.
"""

from pyspark.sql import functions as F

from flowlattice.llm import decontamination, jaccard, packing, quality, toxicity
from flowlattice.llm.common import table
from flowlattice.session import materialized

DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")
ROWS_PER_BATCH = 1000


def _documents(docs):
    """The documents of a stage. Whole texts go to Python, so batches are short from here on, for all of the session."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    return docs.select(*DOCUMENT)


def quality_stage(spark, docs, sf_dir):
    """Documents that the quality rules keep; the verdict is made beside the document, without a shuffle."""
    return quality.quality_rules(_documents(docs), carry=DOCUMENT).where("kept").select(*DOCUMENT)


def toxicity_stage(spark, docs, sf_dir):
    """Documents not predicted to be toxic."""
    return toxicity.toxicity(_documents(docs), table(spark, sf_dir, "labels"), carry=DOCUMENT).where("predicted = 0").select(*DOCUMENT)


def near_duplicate_stage(spark, docs, sf_dir):
    """One document of each group of near duplicates, that of the smallest id."""
    # A null id is in no group.
    docs = _documents(docs)
    copies = jaccard.jaccard_components(docs).where("component_id < doc_id").select("doc_id")
    return docs.join(copies, "doc_id", "left_anti").select(*DOCUMENT)


def decontamination_stage(spark, docs, sf_dir):
    """Documents without any passage of the benchmark."""
    found = decontamination.decontaminate(_documents(docs), table(spark, sf_dir, "benchmark"), carry=DOCUMENT)
    return found.where(~F.col("contaminated")).select(*DOCUMENT)


def packing_stage(spark, docs, sf_dir):
    """The boundary records of the packed sequences."""
    return packing.pack(_documents(docs), packing.vocabulary())


STAGES = [
    ("quality rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("packing", packing_stage),
]

# The stages learn statistics, search by sets or tokenize, which SQL does not express; the tests compare the
# pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialized(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
