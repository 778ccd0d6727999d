"""Secret scan: patterns nominate spans, and decoded structure confirms the ones that patterns alone can't.

``assign``, ``access`` and ``hex`` are the base patterns, reported as they match. The method adds spans whose
bytes prove what they are: base64 or hex text that decodes to a private key (ASN.1 nested lengths that fit
exactly, or OpenSSH's length-prefixed fields), PEM blocks around such bytes, and signed tokens whose header
and claims decode to JSON objects naming an algorithm.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._tokens import as_bytes, map_slices, sliced, with_column

KINDS = ("assign", "access", "hex", "token", "pem", "key64", "keyhex")
RANK = {k: i for i, k in enumerate(KINDS)}

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: A whole run of token characters that two more follow, joined by dots. No run is read again from its inside.
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]++)\.(?=([A-Za-z0-9_-]++)\.([A-Za-z0-9_-]*+))")
#: A JSON object's first bytes in base64.
OBJECT64 = re.compile("e[wy]")
#: Brackets and quotes of JSON, a quote with all backslashes before it.
MARK = re.compile(rb'[{}\[\]]|(?<!\\)\\*+"')
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:(?!-----).)+)-----END \1-----", re.S)
#: A key in base64 starts with M (a SEQUENCE) or b (openssh-key-v1), anywhere in a run; its lines may end as written
#: or escaped.
RUN64_LONG = re.compile(r"[A-Za-z0-9+/]{40,}")
LINE_END = re.compile(r"(?:\r?\n|(?:\\+[rn])+)[\x20\t]*")
ESCAPED = re.compile(r"\\+[rn]")
OPENSSH64 = "b3BlbnNzaC1rZXktdjEA"
#: Where a key may start: the tag of a SEQUENCE and its length in short form or in one to four bytes, or the magic.
KEY64 = re.compile(f"M(?=[A-H]|I[E-T])|{OPENSSH64}")
PADDING = re.compile("={0,2}")
RUN64 = re.compile(r"[A-Za-z0-9+/]*")
#: Object identifiers of password-based encryption: PKCS#5 and PKCS#12.
PBE = (b"\x2a\x86\x48\x86\xf7\x0d\x01\x05", b"\x2a\x86\x48\x86\xf7\x0d\x01\x0c\x01")
RUN_HEX = re.compile(r"[0-9A-Fa-f]{42,}")
_LENGTH = "(?:[0-7].|81..|82.{4}|83.{6}|84.{8})"
#: A SEQUENCE in hexadecimal that starts with a version or with an algorithm.
KEY_HEX = re.compile(f"30(?={_LENGTH}(?:02010[01]|30{_LENGTH}06))")
MIN_KEY64, MIN_KEYHEX = 40, 42
MIN_ASSIGN, MIN_ACCESS = 12, 18


def read_tlv(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, content start, content end) of the DER element at ``at``; None if its length doesn't fit."""
    if at + 2 > end:
        return None
    head = data[at : at + 6]
    tag, n = head[0], head[1]
    at += 2
    if n & 0x80:
        k = n & 0x7F
        if not 0 < k <= 4 or at + k > end:
            return None
        n = int.from_bytes(head[2 : 2 + k], "big")
        at += k
    return (tag, at, at + n) if at + n <= end else None


#: No private key has more elements than an RSA key with further primes.
MOST_CHILDREN = 10


def children(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """The elements that fill start..end exactly, else None; None also if they are too many for a key."""
    out = []
    while start < end:
        if len(out) == MOST_CHILDREN or (e := read_tlv(data, start, end)) is None:
            return None
        out.append(e)
        start = e[2]
    return out


def is_der_key(data: bytes) -> bool:
    """PKCS#1, DSA, PKCS#8 or SEC 1 private key: a SEQUENCE that fills the data, a small version INTEGER, then eight
    or just five INTEGERs, an algorithm SEQUENCE with an OID and an OCTET STRING, or an OCTET STRING of 16 bytes or
    more. Or an encrypted PKCS#8 key: a SEQUENCE with the OID of a password-based encryption, and an OCTET STRING."""
    top = read_tlv(data, 0, len(data))
    if top is None or top[0] != 0x30 or top[2] != len(data):
        return False
    first = read_tlv(data, *top[1:])
    if first is None or first[0] not in (2, 0x30) or not (kids := children(data, *top[1:])) or len(kids) < 2:
        return False
    size = [e - s for _, s, e in kids]
    if kids[0][0] == 0x30:
        inner = children(data, *kids[0][1:])
        return len(kids) == 2 and kids[1][0] == 4 and size[1] >= 16 and bool(inner) and inner[0][0] == 6 and data[inner[0][1] : min(inner[0][2], inner[0][1] + 16)].startswith(PBE)
    if kids[0][0] != 2 or size[0] != 1 or data[kids[0][1] : kids[0][2]][0] > 1:
        return False
    if kids[1][0] == 2:
        return (len(kids) >= 9 or len(kids) == 6) and all(k[0] == 2 for k in kids[:9]) and size[1] >= 16
    if kids[1][0] == 4:
        return size[1] >= 16
    inner = children(data, *kids[1][1:]) if kids[1][0] == 0x30 else None
    return bool(inner) and inner[0][0] == 6 and len(kids) > 2 and kids[2][0] == 4


def is_openssh_key(data: bytes) -> bool:
    """``openssh-key-v1``: cipher, KDF and KDF options as length-prefixed strings, a key count, a public key."""
    magic = b"openssh-key-v1\0"
    if data[: len(magic)] != magic:
        return False
    at = len(magic)
    for step in ("cipher", "kdf", "options", "count", "public"):
        if at + 4 > len(data):
            return False
        n = int.from_bytes(data[at : at + 4], "big")
        at += 4
        if step == "count":
            if not 0 < n < 64:
                return False
            continue
        if at + n > len(data):
            return False
        at += n
    return True


def is_key(data: bytes) -> bool:
    return is_der_key(data) or is_openssh_key(data)


def _b64(text: str, alt: bytes | None = None) -> bytes | None:
    text = text.rstrip("=")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), altchars=alt, validate=True)
    except (binascii.Error, ValueError):
        return None


def is_encrypted_pem(body: str) -> bool:
    """Headers of an encrypted PEM block (Proc-Type, DEK-Info) before whole cipher blocks."""
    if not re.search(r"Proc-Type:\s*4,\s*ENCRYPTED", body) or "DEK-Info:" not in body:
        return False
    data = _b64(_pem_text(body))
    return data is not None and len(data) >= 16 and len(data) % 8 == 0


def _pem_text(body: str) -> str:
    return "".join(x for x in body.split() if ":" not in x and "," not in x)


def _der_bytes(head: bytes | None) -> int | None:
    """Bytes of the DER SEQUENCE whose first six bytes these are."""
    if not head or len(head) < 6 or head[0] != 0x30:
        return None
    n, k = head[1], 0
    if n & 0x80:
        k = n & 0x7F
        if not 0 < k <= 4:
            return None
        n = int.from_bytes(head[2 : 2 + k], "big")
    return 2 + k + n


class Lazy64:
    """The bytes of ``chars`` characters of base64 that start in ``text``; only slices that are asked for are decoded."""

    def __init__(self, text: str, start: int, chars: int):
        self.text, self.start, self.stop = text, start, start + chars

    def __len__(self) -> int:
        return (self.stop - self.start) * 6 // 8

    def __getitem__(self, s: slice) -> bytes:
        a, b, _ = s.indices(len(self))
        if b <= a:
            return b""
        lo = a // 3
        t = self.text[self.start + 4 * lo : min(self.start - 4 * (-b // 3), self.stop)]
        return binascii.a2b_base64(t + "=" * (-len(t) % 4))[a - 3 * lo : b - 3 * lo]


class Block64:
    """Lines of base64 characters, the first given, each joined to the next by a line end, as one string.

    ``at`` and ``offset`` hold where each line starts in the text and in the string. Keys are tried at any place of it;
    as only their lengths and first bytes are decoded, the block is read once, however many places are tried.
    """

    def __init__(self, text: str, start: int, end: int):
        self.text, self.at, self.offset, lines = text, [start], [0], [text[start:end]]
        while gap := LINE_END.match(text, end):
            line = RUN64.match(text, gap.end())[0]
            if not line:
                break
            self.at.append(gap.end())
            self.offset.append(self.offset[-1] + len(lines[-1]))
            lines.append(line)
            end = gap.end() + len(line)
        self.joined, self.end = "".join(lines), end
        self.wide = [len(x) for x in lines]
        #: For each line, the first after it that isn't as wide.
        self.other = [len(lines)] * len(lines)
        for i in range(len(lines) - 2, -1, -1):
            self.other[i] = self.other[i + 1] if self.wide[i] == self.wide[i + 1] else i + 1

    def padded(self, i: int) -> int:
        """The text's place after line ``i`` and its padding."""
        return PADDING.match(self.text, self.at[i] + self.wide[i]).end()

    def key_end(self, start: int) -> int | None:
        """End of the key that starts at this place of the text, else None. A DER key ends where its length says: in its
        line or at the end of a later one. Another key has lines as wide as its first, and one that may be shorter."""
        i = bisect_right(self.at, start) - 1
        j = self.offset[i] + start - self.at[i]
        width = self.offset[i] + self.wide[i] - j
        if self.joined[j] == "M":
            head = binascii.a2b_base64(self.joined[j : j + 12])
            n, tag = _der_bytes(head), 2 + (head[1] & 0x7F if head[1] & 0x80 else 0)
            if n is None or head[tag] not in (2, 0x30):
                return None
            need = -(-n * 8 // 6)
            if need > len(self.joined) - j or not is_der_key(Lazy64(self.joined, j, need)):
                return None
            if need < width:
                return start + need
            last = bisect_left(self.offset, j + need) - 1
            return self.padded(last) if self.offset[last] + self.wide[last] == j + need else None
        last = i
        if i + 1 < len(self.at) and self.wide[i + 1] <= width:
            last = self.other[i + 1] if self.wide[i + 1] == width else i + 1
            last -= last == len(self.at) or self.wide[last] > width
        # what follows the last whole line may be prose
        for n in dict.fromkeys((last, last - 1, i)):
            chars = self.offset[n] + self.wide[n] - j
            if n >= i and chars % 4 != 1 and is_openssh_key(Lazy64(self.joined, j, chars)):
                return self.padded(n)
        return None


def _json_object(part: str) -> dict | None:
    try:
        x = json.loads(_b64(part, b"-_") or b"")
    except (ValueError, RecursionError):
        return None
    return x if isinstance(x, dict) else None


def whole_objects(data: bytes) -> list[int]:
    """Places of the opening brackets that the last character of ``data`` may close, in one reading.

    Whether a place is inside a string depends on where reading starts, in one of two ways: by whether the number of
    quotes before it is even. Each way has one stack of brackets, so at most two places are found.
    """
    end = len(data.rstrip(b" \t\r\n")) - 1
    if end < 0 or data[end] != 0x7D:
        return []
    stacks, way = ([], []), 0
    for m in MARK.finditer(data):
        mark = m[0]
        if mark[-1] == 0x22:
            way ^= len(mark) & 1
        elif mark in b"{[":
            stacks[way].append(m.start())
        else:
            at = stacks[way].pop() if stacks[way] else -1
            if m.start() == end:
                return [at] * (at >= 0)
    return []


def signed_header(run: str) -> int | None:
    """The first place in a run of token characters from where it is a JSON object that names an algorithm."""
    found = []
    for shift in {k.start() & 3 for k in OBJECT64.finditer(run)}:
        data = _b64(run[shift:], b"-_")
        for at in whole_objects(data or b""):
            start = shift + at // 3 * 4
            if at % 3 == 0 and (h := _json_object(run[start:])) is not None and isinstance(h.get("alg"), str):
                found.append(start)
    return min(found, default=None)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], RANK[s[0]]))


def token_spans(text: str) -> list[tuple[int, int]]:
    """Signed tokens. The claims are tested first, then the header at each place in its run where an object can start;
    a part that fails is tried again as the header of the parts after it."""
    out, end = [], 0
    for m in TOKEN.finditer(text):
        if m.start() < end or m[2][0] != "e" or _json_object(m[2]) is None:
            continue
        start = signed_header(m[1])
        if start is not None:
            end = m.end(3)
            out.append((m.start() + start, end))
    return out


def key64_spans(text: str) -> list[tuple[int, int]]:
    out, done, block = [], 0, None
    for m in RUN64_LONG.finditer(text):
        for start in (k.start() for k in KEY64.finditer(text, *m.span())):
            if start < done or m.end() - start < MIN_KEY64:
                continue
            if block is None or start >= block.end:
                block = Block64(text, *m.span())
            if end := block.key_end(start):
                out.append((start, end))
                done = end
    return out


class LazyHex(Lazy64):
    """The same for hexadecimal characters."""

    def __len__(self) -> int:
        return (self.stop - self.start) // 2

    def __getitem__(self, s: slice) -> bytes:
        a, b, _ = s.indices(len(self))
        return bytes.fromhex(self.text[self.start + 2 * a : self.start + 2 * b])


def keyhex_spans(text: str) -> list[tuple[int, int]]:
    """Keys in hexadecimal, wherever in a run they start; the key's length says where it ends."""
    out = []
    for m in RUN_HEX.finditer(text):
        at, end = m.span()
        while k := KEY_HEX.search(text, at, end):
            at = k.start()
            n = _der_bytes(bytes.fromhex(text[at : at + 12]))
            if n and 2 * n <= end - at and 2 * n >= MIN_KEYHEX and is_der_key(LazyHex(text, at, 2 * n)):
                out.append((at, at + 2 * n))
                at += 2 * n
            else:
                at += 1
    return out


def confirmed_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("token", *s) for s in token_spans(text)] if "." in text and ("ey" in text or "ew" in text) else []
    if "-----BEGIN" in text:
        for m in PEM.finditer(text):
            body = ESCAPED.sub("\n", m[2])
            if (data := _b64(_pem_text(body))) and is_key(data) or is_encrypted_pem(body):
                out.append(("pem", *m.span()))
    out += [("key64", *s) for s in key64_spans(text)]
    return out + [("keyhex", *s) for s in keyhex_spans(text)]


def all_spans(text: str) -> list[tuple[str, int, int]]:
    return sorted(base_spans(text) + confirmed_spans(text), key=lambda s: (s[1], RANK[s[0]]))


def _written(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each run of overlapping spans replaced by ``[kind]`` of the first of them."""
    out, at, end, kind = [], 0, -1, ""
    for k, s, e in [*spans, ("", len(text) + 1, len(text) + 1)]:
        if s < end:
            end = max(end, e)
            continue
        if end >= 0:
            out.append(f"[{kind}]")
            at = end
        out.append(text[at : min(s, len(text))])
        kind, end = k, e
    return "".join(out)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: id, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256``, ``spans``, ``redacted`` (null if
    nothing was found).

    Offsets are code points, ends exclusive. Null and empty texts have no spans; repeated rows are each
    reported; invalid UTF-8 counts as replacement characters. Other columns aren't read. No shuffle is made.
    """

    def run(batches):
        for batch in batches:
            for part in sliced(batch, "t"):
                texts = [x.decode("utf-8", "replace") for x in as_bytes(part, "t")]
                base = [base_spans(t) for t in texts]
                every = [sorted(b + confirmed_spans(t), key=lambda s: (s[1], RANK[s[0]])) for b, t in zip(base, texts)]
                count = lambda kind: pa.array([sum(s[0] == kind for s in b) for b in base], pa.int64())
                yield with_column(
                    part,
                    ["id"],
                    n_assign=count("assign"),
                    n_access=count("access"),
                    n_hex=count("hex"),
                    base_sha256=pa.array([hashlib.sha256(_written(b).encode()).hexdigest() for b in base], pa.string()),
                    spans=pa.array([_written(x) for x in every], pa.string()),
                    redacted=pa.array([redact(t, x) if x else None for t, x in zip(texts, every)], pa.string()),
                )

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, redacted string")
    return out.withColumnRenamed("id", id_col)


def redact_documents(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs``; in texts that hold secrets these are replaced and ``n_chars`` is counted anew.

    Rows without secrets, null texts among them, stay as they are, a null or wrong ``n_chars`` too; repeated rows
    change alike; other columns aren't read.
    """

    def change(part):
        texts = [x.decode("utf-8", "replace") for x in as_bytes(part, "text")]
        new = [redact(t, s) if (s := all_spans(t)) else None for t in texts]
        at = {name: i for i, name in enumerate(part.schema.names)}
        columns = list(part.columns)
        found = pa.array([x is not None for x in new], pa.bool_())
        put = lambda name, values: pc.if_else(found, pa.array(values, columns[at[name]].type), columns[at[name]])
        columns[at["text"]], columns[at["n_chars"]] = put("text", new), put("n_chars", [x and len(x) for x in new])
        return pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return map_slices(docs, change)
