"""Wrapping of whole documents against brute force."""

import random
import re

from quillspark.kernel.blocks import parse
from quillspark.kernel.html import to_html
from quillspark.plans import catalog

from .conftest import SF

RNG = random.Random(5)
UNITS = ["`a code span of some length`", "[a link with words](/target/of/the/link)", "![an image](/p.png)", "*emphasis*", "**strong**", "snake_case_word", "considerably", "unbreakable" * 3, "is", "[long link text](" + "/path" * 18 + ")"]


def rendering(text):
    return re.sub(r"\s*\n\s*|\s+", " ", to_html(parse(text or "")))


def cost(lines):
    """Squares of what a line and the space at its end lack, a hundredfold beyond the width; the last line a tenth of what it lacks."""
    out = 0
    for i, x in enumerate(lines):
        last = i == len(lines) - 1
        slack = 80 - len(" ".join(x)) - (not last)
        out += 100 * slack * slack if slack < 0 else 0.1 * slack if last else slack * slack
    return out


def least(units):
    found = float("inf")
    for mask in range(2 ** (len(units) - 1)):
        lines = [[units[0]]]
        for i, u in enumerate(units[1:]):
            lines[-1:] = [lines[-1], [u]] if mask >> i & 1 else [[*lines[-1], u]]
        found = min(found, cost(lines))
    return found


def test_whole_documents(spark, tmp_path):
    parts = [[[RNG.choice(UNITS) for _ in range(RNG.randint(1, 11))] for _ in range(RNG.randint(1, 3))] for _ in range(12)]
    other = ["a | b\n---|---\n`x` | <b>y</b>\n\n> quoted # text ~ and $x$ \\\\ " + "word " * 40 + "\n\n```py\nx = [1]\n```", "# T\n\n- one & " + "two " * 50 + "\n- [l](/u)\n\n***", "", None]
    texts = ["\n\n".join("\n".join(" ".join(p[k : k + 2]) for k in range(0, len(p), 2)) for p in d) for d in parts] + other
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["body"] for r in catalog.QUERIES["fmt_wrap80_whole"](spark, str(tmp_path)).collect()}
    assert sorted(got) == list(range(len(texts)))
    for i, d in enumerate(parts):
        found = got[i].split("\n\n")
        assert len(found) == len(d)
        for units, text in zip(d, found, strict=True):
            rest, lines = list(units), []
            for line in text.split("\n"):
                lines.append([])
                while len(" ".join(lines[-1])) < len(line):
                    lines[-1].append(rest.pop(0))
                assert " ".join(lines[-1]) == line
            assert not rest and abs(cost(lines) - least(units)) < 1e-6
    assert all(rendering(got[i]) == rendering(t) for i, t in enumerate(texts))


def test_no_document_is_left_out(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: r["body"] for r in catalog.QUERIES["fmt_wrap80_whole"](spark, SF).collect()}
    assert got.keys() == docs.keys()
    assert all(rendering(got[i]) == rendering(t) for i, t in docs.items())
