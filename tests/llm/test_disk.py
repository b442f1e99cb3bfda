"""What steps of the pipeline leave on disk."""

import random

from tessera.llm import ngram_join


def held(spark) -> int:
    """Bytes of shuffle files of this session."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).length() for i in range(files.size()))


def test_shuffle_files_of_the_join_go(spark):
    """Shuffles of a step go once its table is written: the disk held those of all steps before."""
    draw = random.Random(3)
    texts = [" ".join(draw.choice("abcdefghij") + str(draw.randrange(3000)) for _ in range(1500)) for _ in range(150)]
    texts += [t + " and more words" for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    was = held(spark)
    linked = ngram_join.link(docs)
    assert held(spark) - was < 500_000
    assert {(r.doc_id, r.component_id) for r in linked.collect()} == {(i, i % 150) for i in range(300)}
