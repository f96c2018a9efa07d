SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, size double, target string, __doc_id string, __st string"
WORDS = "the of and to in that river stone quiet lamp garden window paper market engine copper silver winter harbour letter bridge forest candle morning".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ing", "er"]) for _ in range(n))


def frame(spark, rows):
    """Documents with extra columns whose names the operators might use themselves."""
    full = [(i, t, "en", s, None if t is None else len(t), "x", 0.5, "y", "z", "w") for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA)
