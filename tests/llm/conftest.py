import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(k, n):
    return " ".join(f"w{(k * 31 + i * i * 7 + i) % 997}x{i % 5}" for i in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Nulls in every column, empty and white texts, one long text, exact and near copies, shared passages, repeated lines."""
    base = [sentence(k, 60 + k) for k in range(12)]
    near = base[3].split(" ")
    near[30] = "changed"
    passage = sentence(99, 40)
    texts = [
        *base, base[0], base[0], base[1], " ".join(near), None, "", "  \n\t ", "one", "One  Two", "one two three", base[5] + "\n" + passage, passage + "\n" + base[6],
        "\n".join(["Released under the MIT License."] * 3 + [base[7]]), "All RIGHTS\nreserved. cc-by general public license cc by", "a" * 400, " ".join(["same line here"] * 80), sentence(7, 4000),
        "<|endoftext|> mixed 漢字 é ß \U0001f600 " + base[8], "\n".join(f"user {k} logged in from host{k}" for k in range(30)),
    ]
    return [(k, t, "en" if k % 3 else None, None if k % 5 == 0 else f"s{k % 4}", None if t is None else len(t)) for k, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def odd(spark, corpus):
    """A null doc_id, a repeated row, and columns that clash with the operators' own names."""
    rows = [(None, "a lone text " * 20, None, None, None), corpus[2], corpus[2], corpus[4]]
    clash = "1 AS n, 'x' AS word, 0 AS label, 'y' AS rep, 2 AS spans, 3 AS size, 4 AS copies, 5 AS shard, 6 AS dropped, 7 AS kept_text, 8 AS doc, 9 AS k1, 'z' AS line, 1 AS leaf, 2 AS `key`"
    return spark.createDataFrame(rows, DOCS).selectExpr("*", *clash.split(", "))
