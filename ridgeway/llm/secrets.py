"""Secret scans by structural confirmation.

Patterns only propose. A base64 or hex candidate counts as a key when, decoded, it parses as a key encoding whose
nested lengths add up to the last byte; a signed token counts when its header and payload are JSON objects and the
header names an algorithm. Three base kinds (assignments, access keys, long hex runs) are always reported as the
patterns have them, with a note of what their value decodes to, if anything.

Nulls and empty texts give a row with no spans. Whole texts are scanned, however long. Repeated rows give repeated
results. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeway.llm.common import released, texts

#: In the order that breaks ties of start. The first three are the base kinds.
KINDS = ("assign", "access", "hex", "pem", "jwt", "key64", "keyhex")
BASE = KINDS[:3]

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
#: Runs below the least length fail as a whole, so the length may stand in the pattern.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:(?!-----)[A-Za-z0-9+/=\s\\:,-])*)-----END \1-----")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
#: A DER sequence starts with M in base64, the OpenSSH private key magic with b3BlbnNzaC1rZXktdjE.
_KEY64 = re.compile(r"(?<![A-Za-z0-9+/])(?:M[A-Za-z]|b3BlbnNzaC1rZXktdjE)[A-Za-z0-9+/]{30,}={0,2}")
_KEYHEX = re.compile(r"(?<![0-9A-Fa-f])(?:30|6f70656e7373682d)[0-9A-Fa-f]{60,}")

_OPENSSH = b"openssh-key-v1\0"


class Malformed(ValueError):
    """The bytes are not of the encoding."""


def _tlv(buf: bytes, at: int, end: int) -> tuple[int, int, int]:
    """Tag, start and end of the value of the DER element at a place; it must end within its parent."""
    if at + 2 > end:
        raise Malformed("header past the end")
    tag, n = buf[at], buf[at + 1]
    at += 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or at + k > end:
            raise Malformed("length of length")
        n = int.from_bytes(buf[at : at + k], "big")
        if n < 0x80 or (k > 1 and buf[at] == 0):
            raise Malformed("not the shortest length")
        at += k
    if at + n > end:
        raise Malformed("value past the end")
    return tag, at, at + n


def _children(buf: bytes, at: int, end: int) -> list[tuple[int, int, int]]:
    out = []
    while at < end:
        out.append(_tlv(buf, at, end))
        at = out[-1][2]
    return out


def der_key(buf: bytes) -> str | None:
    """Which private-key encoding a DER value is, if its nested lengths fill it exactly."""
    try:
        tag, a, b = _tlv(buf, 0, len(buf))
        if tag != 0x30 or b != len(buf):
            return None
        parts = _children(buf, a, b)
        tags = [t for t, _, _ in parts]
        ints = [buf[x:y] for t, x, y in parts if t == 0x02]
        if tags == [0x02] * 9 and ints[0] == b"\0":
            return "pkcs1"
        if tags == [0x02] * 6 and ints[0] == b"\0":
            return "dsa"
        if tags[:3] == [0x02, 0x30, 0x04] and ints[0] in (b"\0", b"\1"):
            alg = _children(buf, parts[1][1], parts[1][2])
            return "pkcs8" if alg and alg[0][0] == 0x06 and all(t in (0xA0, 0xA1, 0x81) for t in tags[3:]) else None
        if tags[:2] == [0x02, 0x04] and ints[0] == b"\1" and all(t in (0xA0, 0xA1) for t in tags[2:]):
            for _, x, y in parts[2:]:
                _children(buf, x, y)
            return "sec1"
        if tags == [0x30, 0x04]:
            alg = _children(buf, parts[0][1], parts[0][2])
            return "pkcs8-encrypted" if len(alg) == 2 and alg[0][0] == 0x06 else None
    except Malformed:
        pass
    return None


def openssh_key(buf: bytes) -> str | None:
    """Whether the length-prefixed fields of an OpenSSH private key fill the bytes exactly."""
    if not buf.startswith(_OPENSSH):
        return None
    at = len(_OPENSSH)

    def field() -> bytes:
        nonlocal at
        n = int.from_bytes(buf[at : at + 4], "big")
        if at + 4 + n > len(buf):
            raise Malformed("field past the end")
        at += 4 + n
        return buf[at - n : at]

    try:
        cipher, kdf, _ = field(), field(), field()
        if not cipher or not kdf or at + 4 > len(buf):
            return None
        keys = int.from_bytes(buf[at : at + 4], "big")
        at += 4
        if not 1 <= keys <= 16:
            return None
        for _ in range(keys):
            public = field()
            n = int.from_bytes(public[:4], "big")
            if not 0 < n <= len(public) - 4:
                return None
        private = field()
        return "openssh" if private and len(private) % 8 == 0 and at == len(buf) else None
    except Malformed:
        return None


def _b64(s: str) -> bytes | None:
    """Decoded base64 or base64url, with or without padding; None if it is neither."""
    s = s.rstrip("=")
    if len(s) % 4 == 1:
        return None
    url = "-" in s or "_" in s
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), altchars=b"-_" if url else None, validate=True)
    except (binascii.Error, ValueError):
        return None


def signed_token(s: str) -> str | None:
    """Whether three dotted parts are a signed token: JSON header with an algorithm, JSON payload, signature."""
    parts = s.split(".")
    if len(parts) != 3:
        return None
    try:
        head, body = (json.loads(_b64(p) or b"null") for p in parts[:2])
    except ValueError:  # a UnicodeDecodeError is one
        return None
    except RecursionError:
        return None
    if not isinstance(head, dict) or not isinstance(body, dict) or not isinstance(head.get("alg"), str):
        return None
    if head["alg"].lower() == "none":
        return "jwt-unsigned" if not parts[2] else None
    sig = _b64(parts[2])
    return f"jwt-{head['alg'][:16]}" if sig and len(sig) >= 16 else None


def structure(value: str) -> str:
    """What a candidate decodes to: a key encoding, a signed token, or ''."""
    if value.startswith("eyJ"):
        return signed_token(value) or ""
    found = None
    if re.fullmatch(r"(?:[0-9a-f]{2}){16,}|(?:[0-9A-F]{2}){16,}", value):
        raw = bytes.fromhex(value)
        found = der_key(raw) or openssh_key(raw)
    if not found and len(value) >= 32 and (raw := _b64(value)):
        found = der_key(raw) or openssh_key(raw)
    return found or ""


def find_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, structure) of every span, by start and then kind as listed; code points, end exclusive."""
    out = []
    for m in _ASSIGN.finditer(text):
        if len(m[2]) >= 8:
            out.append(("assign", *m.span(), structure(m[2])))
    if "AKIA" in text:
        out += [("access", *m.span(), "") for m in _ACCESS.finditer(text)]
    out += [("hex", *m.span(), structure(m[0])) for m in _HEX.finditer(text)]
    if "-----BEGIN " in text:
        for m in _PEM.finditer(text):
            body = re.sub(r"\\n|\\r", "", m[2])
            body = "".join(x for x in re.split(r"[\r\n]+", body) if ":" not in x)
            raw = _b64(re.sub(r"\s", "", body))
            if raw and (found := der_key(raw) or openssh_key(raw)):
                out.append(("pem", *m.span(), found))
    if "eyJ" in text:
        for m in _JWT.finditer(text):
            if found := signed_token(m[0]):
                out.append(("jwt", *m.span(), found))
    for kind, pattern in (("key64", _KEY64), ("keyhex", _KEYHEX)):
        for m in pattern.finditer(text):
            if found := structure(m[0]):
                out.append((kind, *m.span(), found))
    rank = {k: i for i, k in enumerate(KINDS)}
    return sorted(out, key=lambda s: (s[1], rank[s[0]], s[2]))


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("structure", pa.string())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = [
            [{"kind": k, "start": a, "end": b, "structure": s} for k, a, b, s in find_spans(text.as_py())]
            for text in batch.column("text")
        ]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, _SPANS)], names=["doc_id", "spans"])


def _redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at = None
    for batch in batches:
        at = batch.schema.get_field_index("text")
        out = []
        for cell in batch.column(at):
            text = cell.as_py()
            out.append(None if text is None else redacted(text))
        columns = list(batch.columns)
        columns[at] = pa.array(out, pa.string())
        yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)


def redacted(text: str) -> str:
    """The text with each run of overlapping spans replaced by the kind of its first."""
    spans = find_spans(text)
    if not spans:
        return text
    parts, at = [], 0
    for kind, start, end, _ in spans:
        if start >= at:
            parts += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<kind,start,end,structure>>), a row for each row of df. No shuffle."""
    rows = texts(df, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lambda it: released(_scan(it)), f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint,structure:string>>")


def redact_secrets(df: DataFrame) -> DataFrame:
    """df with the secrets in its column text masked; every row and column stays."""
    return df.mapInArrow(lambda it: released(_redact(it)), df.schema)


def span_digest(df: DataFrame) -> DataFrame:
    """The report of scan_secrets() as counts, a digest of the base spans, and all spans as a string."""

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda *kinds: F.size(F.filter("spans", lambda s: s["kind"].isin(*kinds))).cast("long")
    return df.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["structure"] != "")).cast("long").alias("n_structural"),
        F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform("spans", lambda s: s["structure"]), lambda x: x != ""))), ",").alias("structures"),
    )


def recounted(df: DataFrame, text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """df with its column of text sizes, if it has one, counted anew in code points."""
    if size_col not in df.columns:
        return df
    kind = df.schema[size_col].dataType
    return df.withColumn(size_col, F.when(F.col(text_col).isNull(), F.col(size_col)).otherwise(F.char_length(text_col)).cast(kind))
