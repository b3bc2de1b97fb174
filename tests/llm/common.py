"""A small corpus with the odd cases, and plain versions of what the contracts say."""

import random
import re

SPACE = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, key string, `group` string, size int, kind int"


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def corpus(seed=3):
    """(doc_id, text): copies, near copies, shared passages, nulls, empty and long texts, odd white space."""
    rng = random.Random(seed)
    vocabulary = ["alpha", "Beta", "gämma", "delta", "ÉTÉ", "zeta", "the", "of", "x", "naïve", "日本", "1.5", "can't", "end."] + [f"w{i}" for i in range(160)]
    words = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, line = words(50), "A common line of boilerplate"
    texts = [None, "", " \n\t", "x", "x y", "one two three", "  " + line.upper() + "\t", line + "\nother\n" + line, "short\nshort"]
    for i in range(60):
        body = words(rng.randint(3, 160))
        if i % 3 == 0:
            cut = rng.randint(0, len(body))
            body = body[:cut] + " " + passage + " " + body[cut:]
        if i % 4 == 0:
            body += "\n" + line
        texts.append(body)
        if i % 5 == 0:
            texts.append(body.replace(" ", "  \x0b"))
        if i % 6 == 0 and len(body.split()) > 60:
            near = body.split(" ")
            near[len(near) // 2] = "changed"
            texts.append(" ".join(near))
    texts += ["copy " * 40] * 3 + [" ".join(f"v{i}" for i in range(300))] * 12 + [words(9000), "a" * 20000]
    texts.append("word " * 100)
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts, strict=True))


def frame(spark, rows, parts=3):
    """The documents table with columns that clash with the operators' own names."""
    sources = ["hot", "hot", "b", "é", None]
    full = [(i, t, "en", sources[(i or 0) % 5], 0, "k", "g", 7, 1) for i, t in rows]
    return spark.createDataFrame(full, COLUMNS).repartition(parts)
