"""Plain restatements of the corpus operators' contracts, to hold results against."""

import hashlib
import math
import re

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def base_spans(text: str) -> list[tuple]:
    """(start, kind, end) of the known forms, ordered."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def joined(spans: list[tuple]) -> str:
    return ",".join(f"{('assign', 'access', 'hex', 'entropy')[k]}:{a}:{b}" for a, k, b in spans)


def digest(spans: list[tuple]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()


def best_entropy(value: str, window: int = 20) -> float:
    """The largest Shannon entropy of a window."""
    best = 0.0
    for i in range(len(value) - window + 1):
        part = value[i : i + window]
        best = max(best, -sum(part.count(c) / window * math.log2(part.count(c) / window) for c in set(part)))
    return best


def candidates(text: str, allowed, allowed_forms: str, hex_bits: float, base64_bits: float) -> list[tuple]:
    """(start, end, class, entropy, verdict) of each candidate."""
    out = []
    for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text):
        v = m[0]
        if re.search("[0-9]", v) and re.search("[A-Za-z]", v):
            kind = "hex" if re.fullmatch("[0-9a-f]+|[0-9A-F]+", v) else "base64"
            bits = best_entropy(v)
            known = any(x in v.lower() for x in allowed) or re.search(allowed_forms, v)
            out.append((m.start(), m.end(), kind, bits, "allowed" if known else "secret" if bits >= (hex_bits if kind == "hex" else base64_bits) else "low"))
    return out


def all_spans(text: str, allowed, allowed_forms: str, hex_bits: float, base64_bits: float) -> list[tuple]:
    return sorted(base_spans(text) + [(a, 3, b) for a, b, _, _, verdict in candidates(text, allowed, allowed_forms, hex_bits, base64_bits) if verdict == "secret"])
