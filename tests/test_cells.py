"""Grapheme clusters and display width, and how paragraphs break: brute force and stored bodies."""

import itertools
import random

import pytest

from quillspark.kernel.cells import clusters, display_width, is_cjk
from quillspark.kernel.markdown import MARKER, break_cost, format_text, line_cost, starts_block, units, width_of, wrap

RNG = random.Random(8)

CLUSTERS = [
    ["é", "a"], ["\r\n", "x"], ["🇩🇪", "🇫🇷", "🇪"], ["👩‍👩‍👧", "👍🏽"], ["❤️", "1️⃣"], ["각", "각", "각"],
    ["नि", "กำ"[:1]], ["؀a"], ["\n", "́"], ["🏴\U000e0067\U000e0062\U000e007f"], ["a‍", "b"], ["👩", "a"],
]


@pytest.mark.parametrize("parts", CLUSTERS, ids=range(len(CLUSTERS)))
def test_clusters(parts):
    assert clusters("".join(parts)) == parts


@pytest.mark.parametrize(("text", "width"), [("", 0), ("abc", 3), ("你好", 4), ("éé", 2), ("🇩🇪🇫🇷", 4), ("👩‍👩‍👧‍👦", 2), ("👍🏽!", 3), ("❤", 1), ("❤️", 2), ("한글", 4), ("한", 2), ("ｱ", 1), ("a​b", 2), ("（x）", 5), ("́", 0), ("1️⃣", 2)])
def test_width(text, width):
    assert display_width(text) == width_of(text) == width


def test_clusters_keep_the_text():
    alphabet = "aé‍️🇩🇪👩👧🏽각각\r\n你नि؀"
    for _ in range(300):
        s = "".join(RNG.choice(alphabet) for _ in range(RNG.randint(0, 12)))
        assert "".join(clusters(s)) == s and all(clusters(c) == [c] for c in clusters(s))


def test_cjk_letters():
    assert all(map(is_cjk, "你かカ한ᄀㄅ々𠀀ｶ")) and not any(map(is_cjk, "aé。，「!1 ")) and not is_cjk("")


# --- breaking -----------------------------------------------------------------------

PIECES = ["word", "considerably", "(aside", "of brackets)", "`code span`", "[a link](/u)", "*strong*", "- ", "3.", "中文", "内容，更多。", "「引用」", "end.", "a, b;", "unbreakable" * 2, "x", "测试（括号）和", "*斜体*的"]


def total(words, cuts, width):
    """The cost of the lines that end behind the units of ``cuts``."""
    out, begin = 0.0, 0
    for end in (*cuts, len(words)):
        line, after = words[begin:end], words[end] if end < len(words) else None
        length = sum(width_of(w.text) for w in line) + sum(w.space for w in line[1:]) + (after is not None and after.space)
        out += line_cost(length, width, line[-1], after)
        begin = end
    return out


@pytest.mark.parametrize("width", [12, 20, 33])
def test_least_of_all_break_sets(width):
    for _ in range(60):
        text = "".join(RNG.choice(PIECES) + RNG.choice([" ", " ", ""]) for _ in range(RNG.randint(1, 8)))
        words = units(text)
        lines, ends, k = wrap(text, width), [], 0
        for line in lines:
            built = words[k].text
            k += 1
            while built != line:
                built += " " * words[k].space + words[k].text
                k += 1
            ends.append(k)
        assert k == len(words)
        least = min(total(words, cuts, width) for n in range(len(words)) for cuts in itertools.combinations(range(1, len(words)), n))
        assert abs(total(words, ends[:-1], width) - least) < 1e-6
        assert "".join(text.split()) == "".join("".join(lines).split())


def test_costs():
    a, b = units("a (b)")
    assert break_cost(a, b) == 5000 and break_cost(*units("x [l](/u)")) == 0 and break_cost(units("x(")[0], a) == 5000 and break_cost(*units("x .y")) == 0
    assert line_cost(10, 10, a, None) == 0 and line_cost(8, 10, a, None) == 0.2 and line_cost(8, 10, *units("a c")) == 4 and line_cost(12, 10, *units("a c")) == 400
    assert line_cost(11, 10, *units("a, c")) == 100 + 80 * 36 and line_cost(5, 10, *units("a -")) == 25 + MARKER and starts_block(units("- x")[0]) and not starts_block(units("-x")[0])


BODIES = [
    (40, "这是一个链接 [示例](https://example.com) 测试。", "这是一个链接 [示例](https://example.com)\n测试。"),
    (60, "我们旨在重现 [eBay TSV Utilities](https://example.com/tsv-utils/blob/master/docs/comparative-benchmarks-of-2017.md) 使用的严格基准测试策略。", "我们旨在重现\n[eBay TSV Utilities](https://example.com/tsv-utils/blob/master/docs/comparative-benchmarks-of-2017.md)\n使用的严格基准测试策略。"),
    (30, "这是一个测试，包含中文逗号。还有更多内容。", "这是一个测试，包含中文逗号。\n还有更多内容。"),
    (55, "这是一个比较长的段落，用于测试行长度是否均衡，不应该出现第一行很短而第二行很长的情况。", "这是一个比较长的段落，用于测试行长度是否均衡，\n不应该出现第一行很短而第二行很长的情况。"),
    (60, "For projects that have finished downloading, but have renamed strains, you can run `reorder.sh` to avoid re-downloading.", "For projects that have finished downloading, but have\nrenamed strains, you can run `reorder.sh` to avoid\nre-downloading."),
    (50, "这是一个 **强调文本** 和 *斜体* 的测试。", "这是一个**强调文本**和*斜体*的测试。"),
    (30, "这是一个 **强调文本** 和 *斜体* 的测试。", "这是一个**强调文本**和*斜体*\n的测试。"),
    (50, "这是一个测试，包含 **强调**、`代码` 和 [链接](https://example.com)。", "这是一个测试，包含**强调**、`代码` 和\n[链接](https://example.com)。"),
    (30, "* Paragraph with hard break and more text.", "- Paragraph with hard break\n  and more text."),
    (30, "1. Paragraph with soft break and more text.", "1. Paragraph with soft break\n   and more text."),
    (25, "> This is a blockquote with some text.", "> This is a blockquote\n> with some text."),
    (30, "**HEPMASS** (4.8GB) 是一个数据集。", "**HEPMASS** (4.8GB)\n是一个数据集。"),
    (30, "这是一个测试 (with English parentheses) 和更多内容。", "这是一个测试 (with English\nparentheses) 和更多内容。"),
    (20, "supercalifragilisticexpialidocious", "supercalifragilisticexpialidocious"),
    (100, "- **建议**: 增强 `tva filter` 或新增 `tva search`，集成 `aho-corasick` crate 以支持高性能的多模式匹配。", "- **建议**: 增强 `tva filter` 或新增 `tva search`，集成 `aho-corasick` crate\n  以支持高性能的多模式匹配。"),
    (40, "这是一个很长的段落，包含很多中文字符和English单词，用来测试行断行功能是否正常工作，以及CJK标点的处理是否正确。", "这是一个很长的段落，\n包含很多中文字符和 English 单词，\n用来测试行断行功能是否正常工作，以及\nCJK 标点的处理是否正确。"),
    (50, "- 行动: 添加 `--relationship` 标志（例如 `one-to-one`, `many-to-one`）在连接时验证键。", "- 行动: 添加 `--relationship` 标志（例如\n  `one-to-one`, `many-to-one`）在连接时验证键。"),
    (40, "除了 `plot`，`xan` 还提供了一个专门的 `hist` 命令 (`xan/src/cmd/hist.rs`)，用于绘制水平条形图。", "除了 `plot`，`xan` 还提供了一个专门的\n`hist` 命令 (`xan/src/cmd/hist.rs`)，\n用于绘制水平条形图。"),
    (80, "这是一个[链接](https://example.com)test示例", "这是一个[链接](https://example.com) test 示例"),
    (80, "# 标题test内容 **粗** 和", "# 标题 test 内容**粗**和"),
]


@pytest.mark.parametrize(("width", "text", "body"), BODIES, ids=range(len(BODIES)))
def test_stored_bodies(width, text, body):
    assert format_text(text, width, True) == body


def test_long_text_without_spaces_is_linear():
    import time

    def took(n):
        began = time.process_time()
        wrap("这是很长的文字，没有空格。" * n, 80)
        return time.process_time() - began

    took(100)
    assert took(8000) < 12 * took(1000) + 0.3


# --- handlers and options ---------------------------------------------------------------


def test_handlers_replace_one_kind():
    from quillspark.kernel.markdown import BLOCKS

    shout = {"heading": lambda n, parts, o, w: BLOCKS["heading"](n, parts, o, w).upper(), "link": lambda n, text, o: f"{text} <{n.at['url']}>", "code": lambda n, text, o: f"[{text}]"}
    assert format_text("# a *b* `c`\n\n[x **y**](/u) and `d`\n\n- [z](/v)", handlers=shout) == "# A *B* [C]\n\nx **y** </u> and [d]\n\n- z </v>"
    items = {"item": lambda n, parts, o, w: f"({len(parts)}) " + BLOCKS["item"](n, parts, o, w), "emph": lambda n, text, o: f"_{text}_"}
    assert format_text("- a *b [c *d*](e)*\n\n  f", handlers=items) == "- (2) a _b [c _d_](e)_\n\n  f"


def test_styles():
    text = "A\n=\n\n## B ##\n\n### C\n\n1) x\n2) y\n\n+ z"
    assert format_text(text, heading="atx", delimiter=".", bullet="*") == "# A\n\n## B\n\n### C\n\n1. x\n2. y\n\n* z"
    assert format_text(text, heading="setext").startswith("A\n===\n\nB\n---\n\n### C\n\n1) x")
    for wrong in ({"heading": "big"}, {"bullet": "x"}, {"delimiter": "]"}):
        with pytest.raises(ValueError, match="unknown"):
            format_text("a", **wrong)


def test_columns_agree_with_the_kernel(spark):
    from pyspark.sql import functions as F

    from quillspark.functions import columns as C

    alphabet = ["a", "é", "e\u0301", "你", "。", "🇩🇪", "👩\u200d👧", "👍🏽", "❤", "❤\ufe0f", "⌚", "한", "각", "\u200b", "（", "ｱ", " ", "1\ufe0f\u20e3", "नि", "😀"]
    texts = ["".join(RNG.choice(alphabet) for _ in range(RNG.randint(0, 9))) for _ in range(400)] + alphabet
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", C.display_width(F.col("t")).alias("w"), C.graphemes(F.col("t")).alias("g")).collect()
    assert [(r["t"], r["w"], r["g"]) for r in rows if r["t"] is not None] == [(t, display_width(t), clusters(t)) for t in texts]
    assert [r["w"] for r in rows if r["t"] is None] == [None]
    marks = spark.createDataFrame([("，",), ("a",), ("「",), ("，，",), ("你a",)], "t string").select(C.is_cjk_punctuation(F.col("t")), C.needs_cjk_spacing(F.col("t")), C.has_cjk(F.col("t"))).collect()
    assert [tuple(r) for r in marks] == [(True, False, False), (False, False, False), (True, False, False), (False, False, False), (False, True, True)]
