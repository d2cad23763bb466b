"""Small tables with the awkward rows that every operator must take."""

import random

DDL = "doc_id long, text string, lang string, source string, n_chars long, size long, fp long, key string, n long, score double, shard int, own long, taken long"


def prose(seed: int, words: int, alphabet: str = "abdeinorst") -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(alphabet) for _ in range(r.randint(2, 7))) for _ in range(words))


def texts() -> list[tuple]:
    """doc_id, text, lang, source."""
    shared, near = prose(1, 110), prose(2, 150)
    rows = [
        (0, None, "en", "s1"),
        (1, "", None, None),
        (2, " \t\n ", "en", "s1"),
        (3, prose(3, 200), "fr", "s1"),
        (4, prose(4, 60) + " " + shared + " " + prose(5, 40), "en", "s2"),
        (5, shared + prose(6, 50), "en", None),
        (6, near, "en", "s1"),
        (7, near, "en", "s1"),
        (8, near + " tail", "xx", "s3"),
        (9, "é" * 150 + "日本語🙂 " * 60, "en", "s1"),
        (10, "x" * 3000, "en", "s1"),
        (11, prose(7, 4000), "de", "s2"),
        (12, prose(8, 90), None, "s2"),
        (12, prose(8, 90), None, "s2"),
        (12, prose(9, 90), None, "s2"),
        (None, prose(10, 80), "en", "s2"),
        (None, prose(11, 80) + " " + shared, "en", "s2"),
        (13, "One two. 'Tis <|endoftext|> it's  2024!\r\n\n  end ", "en", "s3"),
        (14, "The of\x1cand\x85to is in　that for", "en", "s1"),
    ]
    return rows + [(100 + i, prose(100 + i, 40), "en", "s1") for i in range(12)]


def documents(spark, rows=None):
    """With columns that clash with names operators use."""
    rows = texts() if rows is None else rows
    full = [(i, t, lang, s, None if t is None else len(t), 7, 7, "k", 7, 7.0, 7, 7, 7) for i, t, lang, s in rows]
    return spark.createDataFrame(full, DDL)


def key(row):
    return tuple((v is None, str(v)) for v in row)


def same(df, expected):
    assert sorted(map(tuple, df.collect()), key=key) == sorted(expected, key=key)
