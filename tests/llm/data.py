"""Small tables with the cases that every operator has to stand."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, kept boolean, sig string"


def words(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(rng.randrange(40)) for _ in range(n))


def rows():
    base = words(120, 1)
    texts = [
        None, "", "   \n\t ", "!!! 123", "one", "two words", base, base, base.replace("alpha", "Alpha", 1), base + " tail of five words more", words(300, 2),
        words(5000, 3), "Licensed under CC BY-NC 4.0.", "GNU General Public License, version 3. All rights reserved. all RIGHTS reserved", "mail a.b@c.de, ip 10.0.0.1, card 4111 1111 1111 1111, call +1 (319) 555-5132",
        "line\nline\nline\nother", "a b c a b c a b c", "é ü ñ ß", "日本語 テキスト", "x" * 20000, "<|endoftext|> and <|startoftext|>", "\x00\x1f odd \x85 marks", words(49, 4), words(50, 4), words(51, 4),
    ]
    made = [(i + 1, t, "en" if i % 2 else None, "s", None if t is None else len(t), 0.5, True, "x") for i, t in enumerate(texts)]
    made.append((7, base, "de", None, 0, None, None, None))  # a repeated id with the same text
    made.append((None, base, "fr", "s", 1, 1.0, False, ""))  # no id
    made.append((None, "some other words that stand for themselves here", None, None, None, None, None, None))
    return made


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
