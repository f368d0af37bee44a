"""Small tables with the odd rows every operator must take."""

from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # Names that operators use inside.
    T.StructField("t1", T.StringType()), T.StructField("shard", T.StringType()), T.StructField("size", T.StringType()),
    T.StructField("key", T.StringType()), T.StructField("words", T.StringType())])

TEXTS = [
    "The quick brown fox jumps over the lazy dog again and again today.\n shared line \nlast",
    "the QUICK brown fox jumps over the lazy dog again and again today.\nSHARED LINE\t\nother",
    "", None, " \n\t", "one", "Ünïcode ÀÉ straße\nshared line\n", "a b c", "a b c", "word " * 3000,
    "mail me@example.org or +1 (555) 123-4567, ip 10.0.0.1, card 4111 1111 1111 1111.",
]


def documents(spark, texts=TEXTS, repeat_last=True, null_id=True):
    rows = [(i, t, "en", f"s{i % 3}" if i % 4 else None, len(t or "")) for i, t in enumerate(texts)]
    if repeat_last:
        rows.append(rows[0])
        rows.append(rows[0])
    if null_id:
        rows.append((None, "no id at all", None, None, None))
        rows.append((None, texts[0], None, "s1", None))
    return spark.createDataFrame([(*r, "x", "y", "z", "k", "w") for r in rows], DOCUMENTS)


def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
