"""Small documents with the cases that every operator must stand."""

DOCS = "doc_id long, text string"
#: The columns of documents, and names that operators use themselves.
WIDE = "doc_id long, text string, lang string, source string, n_chars long, k string, th string, score string, runs string, bucket int, `class` string, _found string, kept string"


def cases():
    long = " ".join(f"word{k % 977} term{k * 7 % 1009}" for k in range(6000))
    rows = [(1, "the quick brown fox jumps over the lazy dog again and again today"), (2, None), (3, ""), (4, "   \n \n"), (5, "x"), (6, long), (7, long + " tail")]
    rows += [(8, "Zoë – naïve café 🙂 𝔘nicode ſ"), (8, "Zoë – naïve café 🙂 𝔘nicode ſ"), (None, "an id that is null and a text that is not"), (9, None)]
    return rows


def wide(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), "k", None, "score", None, 3, "c", None, "kept") for i, t in rows], WIDE)
