import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns that clash with what the operators compute.
CLASH = "key string, score double, n_tokens string, secrets string, fp string, row string, target double, size string, copies int, features string"


def docs(spark, texts, ids=None, sources=None, clash=False):
    ids = list(range(len(texts))) if ids is None else ids
    sources = ["s"] * len(texts) if sources is None else sources
    rows = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in zip(ids, texts, sources, strict=True)]
    if not clash:
        return spark.createDataFrame(rows, DOCS)
    return spark.createDataFrame([(*r, *["x", 0.5, "x", "x", "x", "x", 0.5, "x", 7, "x"]) for r in rows], f"{DOCS}, {CLASH}")


def odd_texts(long=200_000):
    rnd = random.Random(3)
    words = ["alpha", "beta", "GAMMA", "δέλτα", "x1", "password=hunter22", "日本語", "a.b,c", "!!"]
    return [None, "", " ", "\n\t", "one", "Two words", "İstanbul ΣΑΣ é é", " ".join(rnd.choice(words) for _ in range(long // 6)), "nb\xa0sp\x85x\x1cy", "same text here", "same text here"]


def rows(df):
    return [r.asDict() for r in df.collect()]
