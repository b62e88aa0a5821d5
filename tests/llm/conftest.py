import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


@pytest.fixture(scope="session")
def documents(spark):
    """Rows with every hard case: nulls, empty and long texts, ties, copies, clashing names."""
    base = " ".join(f"w{i % 97}x{i}" for i in range(400))
    shared = " ".join(f"Passage{i}" for i in range(70))
    long = " ".join(f"t{(i * 7919) % 1009}" for i in range(30_000))
    texts = [
        None,
        "",
        " \n\t",
        "one",
        "One two three",
        base,
        base,
        base.replace("w5x5 ", "changed "),
        base + " tail",
        "head one " + shared + " end one",
        "another start " + shared,
        shared.upper(),
        long,
        "ab" * 500,
        "ábc ñandú 日本語 𝔘 <|endoftext|> it's  they're\n",
        "x" * 199,
        "x" * 201,
    ]
    rows = [(i, t, "en", None if i % 5 == 0 else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows += [(None, "null id text", "en", "s1", 1), (3, "one", "en", "s1", 3), (3, "one", "en", "s1", 3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return df, rows
