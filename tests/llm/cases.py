"""Hand-made documents with the hard cases: nulls, empty and long texts, ties, repeats, odd characters."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice(["ta", "ri", "mo", "ne", "su", "É", "x"]) for _ in range(rnd.randrange(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, base = text(60), text(300)
    out = [
        (1, None, "en", "a", None),
        (2, "", "en", "a", 0),
        (3, " \t\n ", None, None, 3),
        (4, "Same Text\there", "en", "b", 1),
        (5, "same text\there", "en", "b", 1),
        (6, "same text here", "en", None, 1),
        (None, "same text\there", "en", "c", 1),
        (None, None, None, None, None),
        (7, "one", "en", "a", 1),
        (8, "one", "en", "a", 1),
        (8, "one", "en", "a", 1),
        (9, "x " * 40000, "en", "long", 1),
        (10, "z" * 200000, "en", "long", 1),
        (11, "É\x85\u00a0\u2003ß \x1c\x0b\x0c end <|endoftext|> x", "fr", "d", 1),
        (12, text(40) + " " + passage + " " + text(10), "en", "a", 1),
        (13, text(20) + "\n" + passage.replace(" ", "\n") + "  " + text(30), "en", "b", 1),
        (14, passage + " " + passage, "en", "b", 1),
        (15, base, "en", "b", 1),
        (16, base + " tail", "en", "b", 1),
        (17, "a b c d e f g h i j " * 30, "en", "é", 1),
        (18, text(34), "en", "\U0001f600", 1),
        (19, text(35), "en", "\uffee", 1),
    ]
    out += [(100 + i, f"{base} n{i}", "en", "hot", 1) for i in range(20)]
    out += [(200 + i, text(rnd.randrange(0, 120)), "en", f"s{i % 7}", 1) for i in range(60)]
    out += [(300 + i, "copied Words in many rows", "en", "hot", 1) for i in range(30)]
    return out


def frame(spark, some=None, extra=False):
    df = spark.createDataFrame(rows() if some is None else some, SCHEMA).repartition(3)
    if extra:
        clash = "score predicted kept digest keep_id group_size ids decoded fp component_id size source_size target copies shard slot h i o t body id key hash part fingerprint n_words".split()
        for c in clash:
            df = df.selectExpr("*", f"'x' as {c}")
    return df
