"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

from pulcro.llm import secret_scan


def entropy(window: str) -> float:
    return -sum(c / len(window) * math.log2(c / len(window)) for c in Counter(window).values())


def secret_spans(text: str | None) -> tuple[dict[str, int], str, str]:
    """Counts by kind, digest of the base spans, all spans."""
    text = text or ""
    flags = re.ASCII
    spans = []
    for m in re.finditer(
        r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        text, flags | re.IGNORECASE,
    ):
        if len(m[2]) >= 12:
            spans.append((m.start(), 0, "assign", m.end()))
    spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    base = sorted(spans)
    for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text):
        hit = m[0]
        if any(re.fullmatch(p, hit) for p in secret_scan.ALLOWED):
            continue
        if any(a < m.end() and m.start() < b for a, _, _, b in base):
            continue
        kind = next(k for k in secret_scan.CLASSES if re.fullmatch(k.pattern, hit))
        best = max(entropy(hit[i : i + kind.window]) for i in range(len(hit) - kind.window + 1))
        if best >= kind.bits:
            spans.append((m.start(), 3, "entropy", m.end()))
    told = [",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(s)) for s in (base, spans)]
    counts = Counter(s[2] for s in spans)
    return counts, hashlib.sha256(told[0].encode()).hexdigest(), told[1]
