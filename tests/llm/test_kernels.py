"""The operators' plain Python parts against brute force."""

import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import common, decontam, embed_join, line_runs, ngram_join, packing, pu_quality, secrets, suffix_dedup, toxicity


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aB \t\n\x0b é", max_size=20), max_size=5))
def test_words(texts):
    raw = [t.encode() for t in texts]
    buf, a, b, of, h = common.words_of(raw)
    got = [(i, bytes(buf[x:y])) for i, x, y in zip(of.tolist(), a.tolist(), b.tolist(), strict=True)]
    assert got == [(i, w) for i, t in enumerate(raw) for w in t.lower().split()]
    names = {}
    for (_, w), v in zip(got, h.tolist(), strict=True):
        assert names.setdefault(w, v) == v
    assert len(set(names.values())) == len(names)


def test_shingles():
    sets = common.shingles_of([b"a b c d e", b"", b"a b", b"A  B\nC d E", b"b a"], 4)
    assert [len(s) for s in sets] == [2, 0, 1, 2, 1]
    assert (sets[0] == sets[3]).all() and sets[2] != sets[4]


@settings(max_examples=80, deadline=None)
@given(st.text("ab", min_size=1, max_size=12), st.text("ab", max_size=25))
def test_myers(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p):
        new = [i + 1]
        for j, b in enumerate(t):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    distance, end = decontam.myers(p, t)
    assert distance == min(row) and row[end] == distance


def test_pigeonhole_finds_every_edited_item():
    rng = random.Random(5)
    items = tuple("".join(rng.choice("abcdefgh ") for _ in range(rng.randint(40, 200))) for _ in range(25))
    budgets = tuple(int(0.08 * len(t)) for t in items)
    automaton = decontam._automaton(items, budgets)
    for i, t in enumerate(items):
        s = list(t)
        for _ in range(budgets[i]):
            p, kind = rng.randrange(len(s)), rng.random()
            if kind < 0.4:
                s[p] = "z"
            elif kind < 0.7:
                s.insert(p, "q")
            else:
                s.pop(p)
        found = {x[0]: x for x in decontam.find_items("zz " * 30 + "".join(s) + " zz" * 30, automaton, items, budgets)}
        assert i in found and found[i][1] <= budgets[i]
    assert decontam.find_items("nothing of the kind", automaton, items, budgets) == []


@settings(max_examples=60, deadline=None)
@given(st.text("abc1", max_size=60))
def test_entropy_runs(text):
    window, least = 8, 1.5
    hit = set()
    for i in range(len(text) - window + 1):
        w = text[i : i + window]
        e = -sum(c / window * math.log2(c / window) for c in (w.count(x) for x in set(w)))
        if e >= least - 1e-9:
            hit |= set(range(i, i + window))
    assert {p for a, b in secrets.entropy_runs(text, window, least) for p in range(a, b)} == hit


def test_secrets():
    t = 'é password = "abcdefghijkl" AKIAABCDEFGHIJKLMN0 token=short api_key:deadbeefdeadbeef00 TOKEN: aaaaaaaaaaaa AKIAXY'
    spans = secrets.base_spans(t)
    assert [k for k, *_ in sorted(spans, key=lambda x: x[1])] == ["assign", "access", "assign", "hex", "assign"]
    assert [s[0] for s in secrets.base_spans("token=secret: abcdefabcdefghij")] == []  # the first match fails and uses up the keyword
    assert secrets.entropy_spans("thisisaverylongplainlowercaseword") == []
    assert secrets.entropy_spans("key Zx9Qw3Er7Ty1Ui5Op0As2Df4 end")[0][0] == "b64win"
    key = "aKdjWqPzLmRtYbVcXsEaGhNu"  # mixed case without a digit
    for before in ("", "example=", "path/to/placeholder/"):
        (span,) = secrets.entropy_spans(before + key)
        assert span[0] == "b64win" and span[2] == len(before) + len(key)
    for allowed in ("getElementFromDocumentIdentifier", "some-path/to/theBigWholeQuick-brownJumpingFox", "myExampleKeyZx9Qw3Er7Ty1Ui5Op0", "2024-01-30/quick_brown_jumpingFox_over=lazyDogs"):
        assert secrets.entropy_spans(allowed) == []


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 50), min_size=1, max_size=9), st.integers(1, 4))
def test_boundaries_are_optimal(hist, k):
    from itertools import combinations

    xs = sorted(hist)

    def pad(bounds):
        return sum((next(b for b in bounds if b >= x) - x) * n for x, n in hist.items())

    best = min(pad([*c, xs[-1]]) for r in range(min(k, len(xs))) for c in combinations(xs[:-1], r))
    got = packing.best_boundaries(list(hist), list(hist.values()), k)
    assert got[-1] == xs[-1] and len(got) <= k and pad(got) == best


@settings(max_examples=40, deadline=None)
@given(st.lists(st.frozensets(st.integers(0, 25), min_size=1, max_size=20), min_size=2, max_size=12), st.sampled_from([(85, 100), (80, 100), (50, 100)]))
def test_link_tile(sets, t):
    num, den = t
    ids = np.arange(len(sets)) + 7
    every = np.ones(len(sets), bool)
    a, b = ngram_join.link_tile(ids, np.array([len(s) for s in sets]), [np.array(sorted(s), np.uint64) for s in sets], every, every, num, den)
    root = {i: i for i in ids.tolist()}
    for _ in range(len(sets)):
        for i, x in enumerate(sets):
            for j, y in enumerate(sets):
                if i != j and den * len(x & y) >= num * len(x | y):
                    root[i + 7] = root[j + 7] = min(root[i + 7], root[j + 7])
    assert dict(zip(a.tolist(), b.tolist(), strict=True)) == {i: r for i, r in root.items() if list(root.values()).count(r) > 1}


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 400), st.floats(0, 1), st.randoms(use_true_random=False), st.sampled_from([(85, 100), (80, 100)]))
def test_signatures_lose_no_link(n, share, rng, t):
    """Sets that link share a signature: the pigeonhole over buckets, empty ones included."""
    num, den = t
    pool = [rng.getrandbits(63) for _ in range(2 * n)]
    x, y = set(pool[:n]), set(pool[:n])
    for _ in range(int(share * 0.2 * n) + 1):  # edit until it is about to stop linking
        old = set(y)
        if rng.random() < 0.5 and len(y) > 1:
            y.discard(rng.choice(sorted(y)))
        else:
            y.add(rng.choice(pool))
        if den * len(x & y) < num * len(x | y):
            y = old
            break
    sig, of = ngram_join.Buckets(num, den).signatures([np.array(sorted(s), np.uint64) for s in (x, y)])
    assert set(sig[of == 0].tolist()) & set(sig[of == 1].tolist())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=1, max_size=15), st.integers(1, 9))
def test_windows(counts, least):
    fwd, back = line_runs.windows(counts, least)
    for i in range(len(counts)):
        f = next((n for n in range(1, len(counts) - i + 1) if sum(counts[i : i + n]) >= least), 0)
        k = next((n for n in range(1, i + 2) if sum(counts[i + 1 - n : i + 1]) >= least), 0)
        assert (fwd[i], back[i]) == (f, k)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.binary(max_size=12).map(lambda b: b"x" * 38 + bytes(c % 3 + 97 for c in b)), min_size=1, max_size=14))
def test_suffix_array(keys):
    m = np.frombuffer(b"".join(k.ljust(104, b"\0") for k in keys), np.uint8).reshape(len(keys), 104)
    order, lcp = suffix_dedup.suffix_array(m, keys)
    assert [keys[i] for i in order] == sorted(keys)


def test_anchors_agree_on_equal_windows():
    rng = random.Random(1)
    core = bytes(rng.choice(b"abc ") for _ in range(100))
    for _ in range(20):
        sides = [bytes(rng.choice(b"abc ") for _ in range(rng.randint(0, 200))) for _ in range(4)]
        texts = [sides[0] + core + sides[1], sides[2] + core + sides[3]]
        h, of, at = suffix_dedup.anchors(texts, 100)
        inside = [{(x, p - len(sides[2 * i])) for x, o, p in zip(h.tolist(), of.tolist(), at.tolist(), strict=True) if o == i and 0 <= p - len(sides[2 * i]) <= 76} for i in (0, 1)]
        assert inside[0] & inside[1]


def test_rotation_keeps_lengths():
    q = embed_join.rotation(32)
    assert np.allclose(q @ q.T, np.eye(32)) and embed_join.block_cuts(64) == [0, 16, 32, 48, 64] and embed_join.block_cuts(3) == [0, 3]


def test_pu_risk_separates():
    rng = np.random.default_rng(0)
    pos, neg = rng.normal(1, 1, (3000, 5)), rng.normal(-1.5, 1, (900, 5))
    unl = np.vstack((rng.normal(1, 1, (2100, 5)), neg))
    score = pu_quality.PriorScore(pos, unl)
    prior = score.prior(dict(zip(*(x.tolist() for x in np.unique(score.above(unl), return_counts=True)), strict=True)))
    assert abs(prior - 0.7) < 0.1
    net = pu_quality.Net(5).fit(pos, unl, prior, epochs=15)
    assert net.score(rng.normal(1, 1, (500, 5))).mean() > 0.8 and net.score(rng.normal(-1.5, 1, (500, 5))).mean() < 0.3


def test_style_features_are_finite():
    f = pu_quality.style_features([b"", b"A B!! c\nd", b"\xff\xfe", b" ", b"x" * 100_000])
    assert f.shape == (5, pu_quality.FEATURES) and np.isfinite(f).all()


def test_grammar():
    g = toxicity.Grammar([(b"lowei", False, 1.5)])
    w = lambda *t: g.weigh([x.encode() for x in t])[:, 0].tolist()
    plain, aimed, negated, quoted, clean, stem = w("an idiot.", "you are an idiot.", "he is not an idiot.", "she said idiot.", "a fine day. not one", "der Loweient!")
    assert aimed > plain > 0 and negated < aimed and quoted < plain * toxicity.TARGETED and clean == 0 and stem == 1.5
    assert [x > 0 for x in w("I will kill time", "I will kill you", "you will kill")] == [False, True, True]
    empty, one, many = w("", "x" * 5000, "idiot " * 2000)
    assert empty == one == 0 < many


def test_isolated_words_do_not_match():
    g = toxicity.Grammar()
    w = lambda *t: g.weigh([x.encode() for x in t])[:, 0].tolist()
    assert w("idiot", "Idiot!", "kill", "you. idiot. kill") == [0, 0, 0, 0]
    assert all(x > 0 for x in w("an idiot", "you idiot", "kill them"))


def test_composition_is_the_product_of_its_parts():
    """The automaton against the parts run side by side over random words of all classes."""
    rng = random.Random(3)
    automaton = toxicity.compose(toxicity.PARTS)
    for _ in range(300):
        state, states = 0, [0] * len(toxicity.PARTS)
        for c in rng.choices(toxicity.CLASSES, k=rng.randint(0, 12)):
            factor = math.prod(p.factor(s) for p, s in zip(toxicity.PARTS, states, strict=True))
            assert automaton.factor[state][c] == (factor if c in (toxicity.INSULT, toxicity.THREAT) else 0)
            state, states = automaton.step[state][c], [p.step(s, c) for p, s in zip(toxicity.PARTS, states, strict=True)]
        ends = [p.final(s) for p, s in zip(toxicity.PARTS, states, strict=True)]
        assert automaton.final[state] == (math.prod(e[0] for e in ends), math.prod(e[1] for e in ends))


def test_grammar_reads_whole_clauses():
    g = toxicity.Grammar([(b"lowei", False, 1.5)])
    w = lambda *t: g.weigh([x.encode() for x in t])[:, :2].tolist()
    fill = "word " * 1000
    aimed, negated, one, two = w("you " + fill + "idiot", "not idiot", "an idiot", "idiot " + fill + "idiot")
    assert w("you are an idiot")[0] == aimed and negated < one < aimed and two == [2 * one[0]] * 2
    assert w("you " + fill + "kill")[0][0] > 0 and w("idiot " + fill + "you idiot")[0][0] > two[0]
    assert w("x" * 1990 + "idiot", "idiot " + "x" * 1991 + "idiot " + fill) == [[0, 0], one]  # no cut makes a word
    texts = ["", "idiot", "a. you idiot! idiot", "\n", "", "kill.", "you;idiot:" + fill, "an idiot; the idiot"]
    assert w(*texts) == [w(t)[0] for t in texts]
    for t in texts:
        sums = [g.clause(c) for c in re.split(rb"[.;:?!\n]", t.encode())]
        assert w(t)[0] == [max(sums), sum(sums)]


def test_target_on_either_side():
    g = toxicity.Grammar()
    w = lambda *t: g.weigh([x.encode() for x in t])[:, 0].tolist()
    before, after, far, two, other, none = w("you kill", "I will kill you", "kill " + "word " * 600 + "them", "kill and burn them", "kill. you", "kill time")
    assert before == after == far == two / 2 > 0 == other == none
    assert w("idiot you")[0] == w("you idiot")[0] > w("an idiot")[0] == w("an idiot! you")[0]
    assert 0 < w("do not kill them")[0] < after and 0 < w("she said kill them")[0] < after
    assert w("kill not them")[0] == after  # a negation acts on what follows


@pytest.mark.parametrize("n", [0, 1, 5])
def test_blind_trie_with_equal_keys(n):
    keys = [b"same"] * n + [b"sam", b"same", b"sand"]
    assert [keys[i] for i in suffix_dedup.blind_trie(list(range(len(keys))), keys)] == sorted(keys)
