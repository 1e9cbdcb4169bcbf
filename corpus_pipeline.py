"""From raw documents to packed training sequences.

Toxic documents go, one document of each group of near copies stays, private values become pseudonyms, the sources are mixed to
their weights, and what the mix takes is packed into sequences.  Every stage works on all its predecessor kept; a stage's result
is a table in the shared folder, so a lost executor costs one stage at most.
"""

from leafgrid.llm.common import table
from leafgrid.llm.mixing import mixture
from leafgrid.llm.ngram_join import without_copies
from leafgrid.llm.packing import pack
from leafgrid.llm.private import with_pseudonyms
from leafgrid.llm.toxicity import without_toxic
from leafgrid.session import stage


def toxicity(spark, docs, sf_dir):
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark, docs, sf_dir):
    return without_copies(docs)


def private_values(spark, docs, sf_dir):
    return with_pseudonyms(docs)


def mixing(spark, docs, sf_dir):
    return mixture(docs)


def packing(spark, docs, sf_dir):
    from public_tokenizers import path

    return pack(docs, path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("near duplicates", near_duplicates),
    ("private values", private_values),
    ("mixing", mixing),
    ("packing", packing),
]
ORACLE_SQL = None  # a trained model decides in the first stage


def run(spark, sf_dir):
    """All stages in turn, applied to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
