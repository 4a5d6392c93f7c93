import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for their results, as columns that come along.
CLASHING = ("shard", "slot", "size", "kept", "ids", "decoded", "media", "payload", "clips", "score", "predicted", "n_shingles", "component_id", "text_sha", "recipe", "kept_text", "kept_bytes", "n_lines", "node", "root", "key", "n", "label")


def corpus() -> list[tuple]:
    """Documents with copies, near copies, repeated rows, nulls, empty, blank and long texts."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdeéßñ") for _ in range(rng.randrange(1, 8))) for _ in range(300)]

    def prose(n: int) -> str:
        return " ".join(rng.choice(words) + rng.choice(["", "", "", ".", "\n"]) for _ in range(n))

    texts = [prose(rng.randrange(1, 200)) for _ in range(60)]
    passage = prose(150)
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(100 + i, texts[i]) for i in range(12)]
    rows += [(120 + i, texts[i].upper()) for i in range(3)]
    for i in range(14):
        w = texts[20 + i % 5].split(" ")
        if len(w) > 3:
            w[rng.randrange(len(w))] = "changed"
        rows.append((140 + i, " ".join(w)))
    rows += [(170 + i, prose(30) + "\n" + passage + "\n" + prose(20)) for i in range(6)]
    rows += [(200, ""), (201, None), (202, "   \n\t "), (203, "one"), (204, "a\n\na\n\na"), (205, ""), (None, "no id here, but a text"), (None, None)]
    rows += [(300, prose(20_000)), (301, "x" * 30_000), (302, "ab " * 9_000), (303, "Ünïcode 文字 🎈 <|endoftext|> tail")]
    rows += [rows[0], rows[0], (201, None), (200, "")]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The corpus with clashing columns besides its own."""
    extra = ", ".join(f"`{c}` string" for c in CLASHING)
    full = [(i, t, "xx", f"s{k % 3}", len(t or ""), *("clash" for _ in CLASHING)) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, f"{SCHEMA}, {extra}").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
