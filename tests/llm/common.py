"""Small inputs with every odd case in them."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, Component string, __gone int, host string, n string"


def prose(rnd, n, vocab=400):
    return " ".join(f"w{int(vocab * rnd.random() ** 2)}" for _ in range(n))


def odd_documents(spark, seed=1, copies=6):
    """Nulls in any column, empty and long texts, repeated rows, ties, near copies, extra columns with clashing names."""
    rnd = random.Random(seed)
    base = [prose(rnd, rnd.choice((3, 20, 60, 200))) for _ in range(30)]
    texts = list(base)
    for t in base[:8]:
        for _ in range(copies):
            w = t.split(" ")
            for _ in range(rnd.randrange(0, 1 + len(w) // 40)):
                w[rnd.randrange(len(w))] = "edited"
            texts.append(" ".join(w))
    texts += ["\n".join([prose(rnd, 12), "shared line " + base[1], "", prose(rnd, 4)]) for _ in range(10)]
    texts += [None, "", " \t\n", "one", "ONE", "É é ß İ 中文 \U0001f600 x", "a\n\n\nb", prose(rnd, 20_000), "<|endoftext|> hi <|endoftext|>", "\x00\x1c\x85 odd", "x" * 5000, " " * 5000]
    rows = [(i, t, "en", f"s{i % 3}", len(t) if t else None, "c", 1, "h", "n") for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, base[2], None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def rows(df):
    return [tuple(r) for r in df.collect()]
