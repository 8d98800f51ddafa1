import random
import zlib

import pytest

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, score string, kept string, words int, held_out int, n long"


def words(text):
    return list(_split(text or ""))


def _split(text):
    word = ""
    for c in text:
        if c in SPACE:
            if word:
                yield word
            word = ""
        else:
            word += c
    if word:
        yield word


def remainder(doc_id, modulus):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus


def make_rows(n=160, seed=5):
    """Prose of a few languages with copies, near copies, ties, nulls, repeated rows, one very long text, a hot source."""
    rng = random.Random(seed)
    vocab = {lang: ["".join(rng.choice(s) for _ in range(rng.randint(1, 3))) for _ in range(300)] + stops for lang, s, stops in (("en", ["the", "ing", "and", "wh", "sh", "ly", "ou"], ["the", "of", "and"] * 40), ("de", ["sch", "ein", "ung", "ber", "ä", "keit"], ["der", "die", "und"] * 40), ("fr", ["é", "eau", "que", "oi", "ment", "è"], ["le", "la", "de"] * 40))}
    rows = []
    for i in range(n):
        lang = rng.choice(list(vocab))
        text = "".join(rng.choice(vocab[lang]) + rng.choice([" ", " ", " ", ", ", ".\n"]) for _ in range(rng.randint(30, 150)))
        rows.append([i, text, lang, "hot" if i % 3 == 0 else f"s{i % 7}"])
    for i in range(0, 40):  # exact copies but for white space, near copies, license lines
        base = rows[i][1]
        if i % 4 == 0:
            text = base.replace(" ", "  ") + "\n"
        elif i % 4 == 1:
            w = base.split(" ")
            w[rng.randrange(len(w))] = "changed"
            text = " ".join(w)
        elif i % 4 == 2:
            text = base + "\nReleased under the MIT License. GNU General Public License, version 3. CC BY-NC 4.0"
        else:
            text = base + ("\n" + base.split("\n")[0]) * 6
        rows.append([n + i, text, rows[i][2], None if i % 5 == 0 else rows[i][3]])
    m = n + 40
    rows += [[m, None, "en", "s1"], [m + 1, "", None, None], [m + 2, " \n\t ", "en", "s1"], [m + 3, "one two", "en", "s2"], [m + 4, "ONE Two", "en", "s2"], [m + 5, "a" * 3000, "xx", "s3"]]
    rows += [[m + 6, " ".join(rng.choice(vocab["en"]) for _ in range(9000)), "en", "s3"], [m + 7, "é😀 日本語 Kelvin K sign mit license", "fr", "ß"], [m + 8, "1234 5678 !!!", "en", "s4"], list(rows[3]), list(rows[3]), [None, "no id", "en", "s1"]]
    rows += [[m + 20 + i, rows[7][1], rows[7][2], "hot"] for i in range(30)]
    return [(*r, len(r[1] or ""), "x", "y", "z", 1, 2, 3) for r in rows]


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("t") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
