"""Plain Python versions of operators, written from their contracts."""

from __future__ import annotations

import hashlib
import re

ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
KINDS = ["assign", "access", "hex", "token", "account", "endpoint"]
WEAK = {
    "token": re.compile(r"[A-Za-z0-9+/_-]{20,}"),
    "account": re.compile(r"""(?i:client_?id|user_?name|account_?id|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}""", re.A),
    "endpoint": re.compile(r"""[a-z][a-z0-9+.-]{1,15}://[^\s"'<>]{3,}""", re.A),
}
CLASS = {"assign": "secret", "access": "id", "hex": "secret", "token": "secret", "account": "id", "endpoint": "endpoint"}


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def all_spans(text: str) -> list[tuple[int, int, str, int]]:
    base = base_spans(text)
    weak = []
    for kind, pattern in WEAK.items():
        for m in pattern.finditer(text):
            if kind == "token":
                good = re.search("[0-9]", m[0]) and re.search("[A-Z]", m[0]) and re.search("[a-z]", m[0])
                covered = any(s <= m.start() < e for s, _, _, e in base)
                if not good or covered or re.search("[0-9a-f]{24,}", m[0]):
                    continue
            weak.append((m.start(), KINDS.index(kind), kind, m.end()))
    kept = list(base)
    for w in weak:
        near = [p for p in base + weak if p[0] <= w[3] + 200 and p[3] >= w[0] - 200]
        others = {"id", "secret", "endpoint"} - {CLASS[w[2]]}
        strong = any(p in base and CLASS[p[2]] in others for p in near)
        if strong or all(any(CLASS[p[2]] == c for p in near) for c in others):
            kept.append(w)
    return sorted(kept)


def listed(spans) -> str:
    return ",".join(f"{name}:{start}:{end}" for start, _, name, end in spans)


def secret_row(doc_id, text: str | None) -> tuple:
    spans = all_spans(text or "")
    base = [s for s in spans if s[1] < 3]
    n = [sum(s[1] == k for s in base) for k in range(3)]
    return (doc_id, *n, hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans))
