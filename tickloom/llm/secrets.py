"""Secret scan with multipart credential linking.

Strong kinds (``assign``, ``access``, ``hex``) are reported wherever they match.
Weak kinds (``ident``, ``secret``, ``endpoint``) are common in innocent text, so
each is reported only where an interval join finds the complementary parts of a
credential within its scope: ``SCOPE`` code points on either side, same document.

* ``ident``    (login = ..., client_id: ...)  needs a secret part in scope;
* ``secret``   (a bare mixed 40-character token) needs an identifier in scope;
* ``endpoint`` (a URL)  needs an identifier and a secret part, all in scope.

Identifiers are ``access`` and ``ident``, secret parts are ``assign``, ``hex`` and
``secret``.  Weak parts confirm one another: all candidates take part in the join
before those without a partner are dropped.  A bare secret may follow ``=`` or ``:``
and stand before ``.``.

The join sorts each kind's intervals once and probes by bisection, so a document
with many parts costs n log n, and no pairs are made.

Nulls: a null text is the empty text; a null doc_id stays null.  Empty texts and
empty tables give zero counts and no rows respectively.  Repeated rows are each
scanned.  Texts are scanned whole, however long.  Columns other than doc_id and
text are never read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tickloom.llm.common import id_text, map_arrow

SCOPE = 300
KINDS = ("assign", "access", "hex", "ident", "secret", "endpoint")
STRONG = KINDS[:3]
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long"


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_LOGINS = "|".join(_either_case(w) for w in ("username", "user", "login", "client_?id", "account"))
_ASSIGN = re.compile(rf"(?:{_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_IDENT = re.compile(rf"(?:{_LOGINS})[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9@._-]{{3,}}")
_SECRET = re.compile(r"(?<![A-Za-z0-9+/_.-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])")
_ENDPOINT = re.compile(r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?[A-Za-z0-9/_.~%-]*")


def _strong(text: str) -> dict[str, list[tuple[int, int]]]:
    return {
        "assign": [m.span() for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6] if ("=" in text or ":" in text) else [],
        "access": [m.span() for m in _ACCESS.finditer(text)] if "AKIA" in text else [],
        "hex": [m.span() for m in _HEX.finditer(text)],
    }


class _Parts:
    """Intervals of one role, for bisection by start; they are narrow against the scope."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.spans = sorted(spans)
        self.starts = [s for s, _ in self.spans]
        self.reach: list[int] = []  # the furthest end so far, so that one long part is not missed
        for _, e in self.spans:
            self.reach.append(max(e, self.reach[-1]) if self.reach else e)

    def near(self, start: int, end: int, scope: int) -> bool:
        """Whether some part overlaps [start - scope, end + scope)."""
        right = bisect_right(self.starts, end + scope)
        return right > 0 and self.reach[right - 1] >= start - scope


def scan_text(text: str, scope: int = SCOPE) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """The strong spans of a text and the weak spans that linking confirms, by kind."""
    strong = _strong(text)
    weak: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS[3:]}
    taken = _Parts([s for k in STRONG for s in strong[k]])
    free = lambda s, e: not taken.near(s + 1, e - 1, 0)
    ident = [m.span() for m in _IDENT.finditer(text) if free(*m.span())] if ("=" in text or ":" in text) else []
    if not ident and not strong["access"]:
        return strong, weak
    secret = [m.span() for m in _SECRET.finditer(text) if _mixed(m[0]) and free(*m.span())]
    who, what = _Parts(strong["access"] + ident), _Parts(strong["assign"] + strong["hex"] + secret)
    weak["ident"] = [x for x in ident if what.near(*x, scope)]
    weak["secret"] = [x for x in secret if who.near(*x, scope)]
    # a partner may be any candidate: an identifier and a secret part near a URL are linked with it
    if what.spans and "://" in text:
        weak["endpoint"] = [m.span() for m in _ENDPOINT.finditer(text) if who.near(*m.span(), scope) and what.near(*m.span(), scope)]
    return strong, weak


def _mixed(token: str) -> bool:
    return any(c.isdigit() for c in token) and any(c.islower() for c in token) and any(c.isupper() for c in token)


def joined(spans: dict[str, list[tuple[int, int]]]) -> str:
    rows = sorted((s, KINDS.index(k), e) for k, v in spans.items() for s, e in v)
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in rows)


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row per document: counts of strong kinds, their digest, and all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for text in b.column(1).to_pylist():
                strong, weak = scan_text(text or "", scope)
                for k, name in enumerate(STRONG):
                    out[k].append(len(strong[name]))
                out[3].append(hashlib.sha256(joined(strong).encode()).hexdigest())
                out[4].append(joined(strong | weak))
                out[5].append(sum(map(len, weak.values())))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.string()), pa.array(out[4], pa.string()), pa.array(out[5], pa.int64())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked"],
            )

    return map_arrow(id_text(docs), run, SCHEMA)
