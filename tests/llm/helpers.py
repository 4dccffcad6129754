"""Small documents with every awkward case, and a writer that makes them a table of files."""

import random

EDGES = [
    (None, "An id that is null."),
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "word " * 4000),
    (5, "same text twice, the very same text"),
    (6, "same text twice, the very same text"),
    (6, "same text twice, the very same text"),
    (7, "ünïcödé 字漢 \U0001f600 ça va bien, n'est-ce pas?"),
    (8, "#*$%&|<> !!! ???"),
    (9, "it's 'tis they'll\n\n\nI'd  we've   ''s '"),
]


def sentences(seed, n, lang="en"):
    words = {"en": "the of and that with house river green walks slowly under bridge".split(), "de": "der die und nicht haus fluss grün geht langsam unter brücke zwischen".split()}[lang]
    r = random.Random(seed)
    return " ".join(r.choice(words) + ("." if r.random() < 0.1 else "") for _ in range(n))


def table(spark, tmp_path, name, rows, schema="doc_id long, text string", parts=3):
    path = str(tmp_path / name)
    spark.createDataFrame(rows, schema).repartition(parts).write.parquet(path)
    return spark.read.parquet(path)


def clashing(df):
    """The same with columns of the names that operators use inside and in their results."""
    from pyspark.sql import functions as F

    extra = "key sig group score kept shard slot n_words lang_pred ids chunk part blob held _text _id _row hashes n".split()
    return df.select("*", *(F.lit("x").alias(c) for c in extra if c not in df.columns))
