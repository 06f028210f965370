"""Secret scan (operator 5): key-like patterns, and windows of high entropy.

Candidate strings are runs of key characters.  Over each one a window slides
per character class; its Shannon entropy is kept by incremental counts, so one
step costs two table look-ups however long the window is.  Windows at or above
the class threshold become spans unless the allow-list covers every part between
separators that they touch; so a key stays found behind a path or a placeholder.

Defined cases: a null text is an empty one and has no spans; repeated rows are
scanned each; positions are code points with exclusive ends, whatever the
length of the text; of spans that start together the kind listed first comes
first; other columns, whatever their names, are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed patterns of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Per class: its members, the window and the least entropy in bits a character.
CLASSES = {
    "hexwin": (re.compile(r"[0-9A-Fa-f]{20,}"), 20, 3.0),
    "b64win": (re.compile(r"[A-Za-z0-9+/=_-]{20,}"), 20, 3.9),
}
#: The allow-list, for what stands between separators: words, camel case with humps of three letters or more, numbers, placeholders.
PART = re.compile(r"[^-_=+/]+")
ALLOW = re.compile(r"[a-z]*(?:[A-Z][a-z]{2,})*|[A-Z]+|[0-9]+|(?i:.*(?:example|placeholder|xxxx|changeme|lorem).*)")
KINDS = ("assign", "access", "hex", "hexwin", "b64win")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12] if ":" in text or "=" in text else []
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    return found + [("hex", *m.span()) for m in HEX.finditer(text)]


def entropy_runs(text: str, window: int, least: float) -> list[tuple[int, int]]:
    """Merged [start, end) unions of the windows of ``text`` whose Shannon entropy is at least ``least``.

    ``s`` is the sum of c*log2(c) over the counts c in the window; entropy is
    log2(window) - s / window, and a step changes two counts.
    """
    if len(text) < window:
        return []
    cost = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    counts: dict[str, int] = {}
    s, top, runs = 0.0, math.log2(window), []
    for i, ch in enumerate(text):
        c = counts.get(ch, 0)
        counts[ch] = c + 1
        s += cost[c + 1] - cost[c]
        if i >= window:
            old = text[i - window]
            c = counts[old]
            counts[old] = c - 1
            s += cost[c - 1] - cost[c]
        if i >= window - 1 and top - s / window >= least - 1e-9:
            a, b = i - window + 1, i + 1
            if runs and a <= runs[-1][1]:
                runs[-1] = (runs[-1][0], b)
            else:
                runs.append((a, b))
    return runs


def entropy_spans(text: str) -> list[tuple[str, int, int]]:
    """High-entropy runs of candidates that touch a part which the allow-list does not cover."""
    found = []
    for m in CANDIDATE.finditer(text):
        odd = [p.span() for p in PART.finditer(text, m.start(), m.end()) if not ALLOW.fullmatch(p[0])]
        if not odd:
            continue
        ends = [z for _, z in odd]
        for kind, (members, window, least) in CLASSES.items():
            for part in members.finditer(m[0]):
                for a, b in entropy_runs(part[0], window, least):
                    a, b = a + m.start() + part.start(), b + m.start() + part.start()
                    k = bisect.bisect_right(ends, a)  # the first such part that ends behind the run's start
                    if k < len(odd) and odd[k][0] < b:
                        found.append((kind, a, b))
    return found


def render(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scan every whole text: (doc_id, n_assign, n_access, n_hex, n_entropy, base, spans).

    ``base`` and ``spans`` list kind:start:end; ``spans`` also has the entropy
    windows.  One Arrow pass without a shuffle.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))

    def scan(batches):
        for b in batches:
            out = []
            for text in b.column(1):
                text = text.as_py() or ""
                base = base_spans(text)
                more = entropy_spans(text)
                kinds = [x[0] for x in base]
                plain = render(base)
                out.append((kinds.count("assign"), kinds.count("access"), kinds.count("hex"), len(more), plain, hashlib.sha256(plain.encode()).hexdigest(), render(base + more)))
            cols = list(zip(*out, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.string()) for c in cols[4:])], names=["doc_id", "n_assign", "n_access", "n_hex", "n_entropy", "base", "base_sha256", "spans"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scan, f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_entropy long, base string, base_sha256 string, spans string")
