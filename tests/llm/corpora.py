"""Small tables with every awkward case, and plain readings of the contracts to hold results against."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(text or "")


def sample(seed=1, n=60):
    """Rows with copies, near copies, shared passages, repeated lines, nulls, empties, odd white space and a long text."""
    import random

    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéßñ") for _ in range(r.randint(2, 7))) for _ in range(400)]
    passage = " ".join(r.choice(vocabulary) for _ in range(60))
    rows, texts = [], []
    for i in range(n):
        lines = [" ".join(r.choice(vocabulary) for _ in range(r.randint(3, 14))) for _ in range(r.randint(1, 12))]
        if i % 7 == 3:
            lines.insert(len(lines) // 2, passage)
        if i % 9 == 4:
            lines += lines[:2]
        text = "\n".join(lines)
        if i % 5 == 2 and texts:
            text = r.choice(texts)
        if i % 6 == 5 and texts:
            w = r.choice(texts).split(" ")
            for _ in range(max(1, len(w) // 60)):
                w[r.randrange(len(w))] = "CHANGED"
            text = " ".join(w)
        texts.append(text)
        rows.append((i, text, r.choice(["en", "fr", None]), r.choice(["s1", "s1", "s1", "s2", None]), len(text)))
    odd = [None, "", " \n\t ", "one", "a b c", "\x1f x y  z\x0b\x0cq\r\n", "Tab\tsep  two\n\nlines\n", "😀 astral ß É é <|endoftext|> don't 'S", "la la la la la la la la la la la la", " ".join(vocabulary * 20), " ".join(vocabulary * 20)]
    rows += [(n + i, t, None, "s3", 0) for i, t in enumerate(odd)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)
