"""The corpus pipeline: from raw documents to a training mix.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and returns
the columns of documents (the last adds copy and mix_key). Rows are judged as the operators define.
"""

from tideframe.llm import decontaminate, mixing, neardup, quality, substrings
from tideframe.llm.common import stored, table
from tideframe.session import ship


def quality_rules(spark, docs, sf_dir):
    """Documents that pass the quality rules."""
    return quality.keep(docs)


def near_duplicates(spark, docs, sf_dir):
    """One document of each class of near duplicates."""
    ship(spark)
    return neardup.keep_one(docs)


def repeated_passages(spark, docs, sf_dir):
    """Documents without the passages that an earlier document holds already."""
    ship(spark)
    return substrings.strip(docs)


def decontamination(spark, docs, sf_dir):
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark, docs, sf_dir):
    """Documents repeated by their source's rate, in mixed order."""
    return mixing.mix(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("decontamination", decontamination),
    ("source mixing", source_mixing),
]

#: Weighted sampling and byte ranges have no SQL form; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over the documents of sf_dir, each written as Parquet and reread as the next one's docs."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
