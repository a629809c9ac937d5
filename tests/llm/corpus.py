"""Small tables with the awkward cases every operator must take."""

import random

DOCUMENTS = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, size string, "
    "key string, kept string, length string, part int"
)


def prose(seed: int, words: int) -> str:
    pick = random.Random(seed)
    made = ["".join(pick.choice("abcdeé") for _ in range(pick.randint(2, 7))) for _ in range(words)]
    return " ".join(w + ("." if k % 9 == 8 else "") + ("\n" if k % 40 == 39 else "") for k, w in enumerate(made))


def changed(text: str, seed: int, times: int) -> str:
    pick, words = random.Random(seed), text.split(" ")
    for _ in range(times):
        words[pick.randrange(len(words))] = f"x{seed}"
    return " ".join(words)


def awkward() -> list[tuple]:
    long = prose(1, 9000)
    base = prose(2, 200)
    texts = [None, "", " \n\t ", "one", "two words", "a b c d", "A  b\nc d e", base, base, base.upper()]
    texts += [changed(base, k, 1 + k % 9) for k in range(12)]
    texts += [long, long + " tail", prose(3, 60), "<|endoftext|> # $ | x", "あい \U0001f600 z" * 30]
    texts += ["buy now!! " * 60, "\n".join(["same line of words here"] * 20)]
    sources = ["b", "a", None, "b", "cé", ""]
    rows = [(10 * k + 3, t, "en", sources[k % 6], 0, 0.5, "s", "k", "y", "l", k) for k, t in enumerate(texts)]
    rows += [rows[7], rows[7], (None, "no id here", None, None, None, None, None, None, None, None, None)]
    return rows


def frame(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, DOCUMENTS)


def pandas(df):
    return [r.asDict() for r in df.collect()]
