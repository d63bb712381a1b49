"""Secret scans: a keyword automaton first, anchored patterns only where a keyword stands, then embedded checks.

One Aho-Corasick automaton reads a whole slice of texts once. At each keyword hit the pattern of that kind is tried
at the hit alone; since every pattern begins with its keyword, this gives what a search over the text would give
(leftmost, non-overlapping per kind). Long hexadecimal runs have no keyword and come from one vectorised pass over
the bytes. Kinds with a built-in checksum or structure are kept only if it holds.

Null and empty texts have no secrets. Offsets are code points of the text, end exclusive. Repeated rows give repeated
results; other columns of the input stay as they are; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import byte_class, prepare, query, runs, slices, table, utf8

BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62_crc(body: bytes) -> bytes:
    """CRC-32 of ``body`` as six digits of base 62, as access tokens carry it at their end."""
    rest, out = zlib.crc32(body), ""
    for _ in range(6):
        rest, digit = divmod(rest, 62)
        out = BASE62[digit] + out
    return out.encode()


def _token_ok(m: re.Match[bytes]) -> bool:
    return base62_crc(m[1][:30]) == m[1][30:]


def _jwt_ok(m: re.Match[bytes]) -> bool:
    try:
        head = json.loads(base64.urlsafe_b64decode(m[1] + b"=" * (-len(m[1]) % 4)))
    except ValueError:
        return False
    return isinstance(head, dict) and "alg" in head


@dataclass(frozen=True)
class Kind:
    """A kind of secret: the words it begins with (lower case), its pattern, and what a match must also satisfy."""

    name: str
    keywords: tuple[str, ...]
    pattern: re.Pattern[bytes]
    valid: Callable[[re.Match[bytes]], bool] = lambda m: True


# Kinds and patterns. The first two and "hex" are the base; the others are this operator's own.
KINDS = (
    Kind(
        "assign",
        ("password", "passwd", "secret", "token", "apikey", "api_key"),
        re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I),
        lambda m: len(m[2]) >= 12,
    ),
    Kind("access", ("akia",), re.compile(rb"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    Kind("github", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(rb"gh[pousr]_([A-Za-z0-9]{36})(?![A-Za-z0-9])"), _token_ok),
    Kind("npm", ("npm_",), re.compile(rb"npm_([A-Za-z0-9]{36})(?![A-Za-z0-9])"), _token_ok),
    Kind("jwt", ("eyj",), re.compile(rb"(eyJ[A-Za-z0-9_-]+)\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]{16,}"), _jwt_ok),
    Kind("pem", ("-----begin ",), re.compile(rb"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]*PRIVATE KEY-----)?")),
    Kind("google", ("aiza",), re.compile(rb"AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])")),
    Kind("slack", ("xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-"), re.compile(rb"xox[abprs]-[0-9]{6,}-[A-Za-z0-9-]{10,}")),
    Kind("stripe", ("sk_live_", "rk_live_"), re.compile(rb"[sr]k_live_[A-Za-z0-9]{16,}")),
)
HEX_LEAST = 16
BASE = ("assign", "access", "hex")
#: Order of kinds that begin at the same place.
ORDER = {name: k for k, name in enumerate([*BASE, *(x.name for x in KINDS if x.name not in BASE)])}
HEX = byte_class((0x30, 0x39), (0x61, 0x66))

Span = tuple[int, int, int]  # start, order of the kind, end; in bytes of the slice
_automaton: list[ahocorasick.Automaton] = []


def _keywords() -> ahocorasick.Automaton:
    if not _automaton:
        a = ahocorasick.Automaton()
        for kind in KINDS:
            for word in kind.keywords:
                a.add_word(word, (kind, len(word)))
        a.make_automaton()
        _automaton.append(a)
    return _automaton[0]


def _slice_spans(data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, Span]]:
    """(row, span) of all secrets in these rows, in order."""
    raw = data.tobytes()
    found: list[tuple[int, Span]] = []
    after: dict[tuple[int, str], int] = {}
    hits = [(end - size + 1, kind) for end, (kind, size) in _keywords().iter(raw.lower().decode("latin-1"))]
    hits.sort(key=lambda x: x[0])
    rows = np.searchsorted(offsets, np.array([x[0] for x in hits], np.int64), "right") - 1
    for (start, kind), row in zip(hits, rows.tolist(), strict=True):
        if start < after.get((row, kind.name), 0):
            continue
        m = kind.pattern.match(raw, start, int(offsets[row + 1]))
        if m:
            after[row, kind.name] = m.end()
            if kind.valid(m):
                found.append((row, (start, ORDER[kind.name], m.end())))
    starts, ends = runs(HEX[data], offsets)
    long = ends - starts >= HEX_LEAST
    at = starts[long]
    rows = np.searchsorted(offsets, at, "right") - 1
    found += zip(rows.tolist(), zip(at.tolist(), [ORDER["hex"]] * len(at), ends[long].tolist(), strict=True), strict=True)
    return sorted(found)


def spans_of(column: pa.Array) -> list[list[Span]]:
    """Spans of each text, in bytes of that text."""
    data, offsets = utf8(column)
    out: list[list[Span]] = [[] for _ in range(len(column))]
    for i, j in slices(offsets):
        base = offsets[i]
        for row, (start, kind, end) in _slice_spans(data[base : offsets[j]], offsets[i : j + 1] - base):
            shift = int(offsets[i + row] - base)
            out[i + row].append((start - shift, kind, end - shift))
    return out


def _prepared(texts: pa.Array) -> pa.Array:
    texts = texts if texts.type == pa.string() else texts.cast(pa.string())
    return texts.fill_null("") if texts.null_count else texts


NAMES = list(ORDER)


def _secrets(texts: pa.Array) -> pa.Array:
    texts = _prepared(texts)
    out = []
    for k, spans in enumerate(spans_of(texts)):
        if not spans:
            out.append([])
            continue
        raw = texts[k].as_py().encode()
        plain = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
        at = lambda b, plain=plain: int(plain[b - 1]) if b else 0
        out.append([{"kind": NAMES[kind], "start": at(start), "end": at(end)} for start, kind, end in spans])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    return pa.array(out, kind)


def secrets(text: Column | str) -> Column:
    """Array of (kind, start, end) of the secrets of a text, by start, then kind."""
    return F.arrow_udf(_secrets, "array<struct<kind:string,start:bigint,end:bigint>>")(text)


def redacted(text: Column | str, mark: str = "[secret]") -> Column:
    """The text with each secret (overlapping ones together) replaced by ``mark``; null stays null."""
    put = mark.encode()

    @F.arrow_udf("string")
    def cut(texts: pa.Array) -> pa.Array:
        out: list[str | None] = []
        for k, spans in enumerate(spans_of(_prepared(texts))):
            whole = texts[k].as_py()
            if not spans or whole is None:
                out.append(whole)
                continue
            raw, parts, done = whole.encode(), [], 0
            for start, _, end in spans:
                if start >= done:
                    parts += [raw[done:start], put]
                done = max(done, end)
            out.append(b"".join([*parts, raw[done:]]).decode())
        return pa.array(out, pa.string())

    return cut(text)


def find_secrets(docs: DataFrame, text: str = "text", into: str = "secrets") -> DataFrame:
    """``docs`` with an array of found secrets."""
    prepare(docs.sparkSession)
    return docs.withColumn(into, secrets(text))


def redact_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the secrets in ``text`` masked; every row stays."""
    prepare(docs.sparkSession)
    return docs.withColumn(text, redacted(text))


def _joined(spans: Column) -> Column:
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


@query("op10_secret_scan")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    docs = find_secrets(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "secrets")
    of = lambda name: F.size(F.filter("secrets", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")
    base = F.filter("secrets", lambda s: s["kind"].isin(*BASE))
    return docs.select("doc_id", *map(of, BASE), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("secrets")).alias("spans"))
