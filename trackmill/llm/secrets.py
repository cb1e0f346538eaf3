"""Secret scan with structural confirmation.

Three base patterns give spans as they match: assignments to a name such as password, access keys, and long hex strings.
The method adds spans only of candidates whose decoded content has the structure of a private key or token:

* jwt: three base64url parts whose header is a JSON object that names an algorithm and whose second part is a JSON object
  (signed), or five parts whose header also names an encryption (encrypted); parts that follow, as a full stop makes them, are
  left out, and the last part is empty only where the header names no algorithm;
* pem: a BEGIN/END block with a PRIVATE KEY label whose body is base64 of a private key in DER, of an OpenSSH key, or of a body that
  its own headers say is encrypted (a cipher with an initial value, whole blocks); lines may be escaped or quoted as in JSON and
  source text;
* der: a base64 or hex run that is exactly one private key in DER: every nested length fits its parent, and the parts are those of
  PKCS#1, PKCS#8 (plain, with the key's own structure inside for known algorithms, or encrypted), SEC1 or DSA keys;
* ssh: a base64 run that is an OpenSSH private key: all its length-prefixed fields end where it ends, and an unencrypted private
  section repeats its check number and ends in its padding.

Public keys and certificates are no secrets. Base64 runs of der and ssh may be wrapped in lines, with line ends as they are or
escaped, and may follow or precede a slash or another sign of the alphabet.

Every text is passed over by patterns that visit whole runs once. Of a run's candidates for keys only the heads of the nested values are read, in
place, and what is found about them is kept for other candidates that hold the same values; of a token's candidates for headers only
those are decoded whose braces close where the part ends. So the time grows in proportion to the text. Spans count code points, the end is
exclusive; they are leftmost and do not overlap within a kind; an added span never replaces a base one. Null and empty texts have
no spans. A row of the input gives one row. Only the two named columns are read.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, pass_rows

#: In the order in which spans with the same start are listed.
KINDS = ["assign", "access", "hex", "jwt", "pem", "der", "ssh"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_HINT = re.compile(rb"passwd|password|secret|token|api_?key")
LEAST = {"assign": 12, "access": 18, "hex": 16}
#: As `[A-Z0-9]+` and `[0-9a-f]+` take whole runs, matches that are too short can be left out by the pattern.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: In source and JSON texts: escaped line ends and slashes, and strings that go on in the next one.
PEM_JOINT = re.compile(r"""(?<!\\)\\++(?:[nrt/]|\r?\n)|["'][\x20\t\r\n]*+(?:[+.,][\x20\t\r\n]*+)?["']""")
PEM_MARK = re.compile(r"-----(BEGIN|END) ((?:[A-Z0-9]{1,24} ){0,4}PRIVATE KEY)-----")
PEM_BODY = re.compile(r"[\sA-Za-z0-9+/=]*")
PEM_HEADER = re.compile(r"(?m)^[\x20\t]*[A-Za-z-]+:.*$")
ENCRYPTED = re.compile(r"DEK-Info:\s*(?:AES-\d+|CAMELLIA-\d+|DES-EDE3|DES|IDEA|SEED)-[A-Z0-9]+,\s*([0-9A-Fa-f]{16}|[0-9A-Fa-f]{32})\b")
SIGN = "A-Za-z0-9+/_-"
RUN = re.compile(rf"(?<![{SIGN}])[{SIGN}]{{40,}}+={{0,2}}+")
#: Places in a run at which a key can begin: DER SEQUENCEs and OpenSSH's magic in base64, behind an edge.
BEGIN = re.compile(r"(?:^|(?<=[+/_-]))(?:M[A-Za-z0-9+/_-]|b3BlbnNzaC1rZXktdjEA)")
DOTTED = re.compile(r"[A-Za-z0-9_.-]{8,}+")
HEAD = re.compile(r"(?:^|(?<=[_-]))eyJ(?=[A-Za-z0-9_-]{5})")
#: Lines of base64 with nothing else between their first and last sign but line ends and indents.
LINE_END = r"[\x20\t]*+(?:\\++r)?(?:\r?\n|\\++n)[\x20\t]*+"
LINES = re.compile(rf"(?<![{SIGN}])[{SIGN}]{{16,}}+={{0,2}}+(?:{LINE_END}[{SIGN}]++={{0,2}}+)+")
HEX_RUN = re.compile(r"(?<![0-9A-Fa-f])30[0-9A-Fa-f]{38,}+")
OPENSSH = b"openssh-key-v1\0"
#: Object identifiers, as their DER bytes.
RSA, DSA, EC = (bytes.fromhex(x) for x in ("2a864886f70d010101", "2a8648ce380401", "2a8648ce3d0201"))
EDWARDS = {bytes.fromhex("2b65") + bytes([n]): size for n, size in ((0x6E, 32), (0x6F, 56), (0x70, 32), (0x71, 57))}
PASSWORD_BASED = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
INTEGER, OCTETS, OID, SEQUENCE = 0x02, 0x04, 0x06, 0x30
#: Levels of nested values; keys have no more than six.
DEPTH = 32


def unbase64(text: str) -> bytes | None:
    """The bytes of base64 in either alphabet, padded or not; None if it is neither."""
    text = "".join(text.split()).rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


SIX = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_", bytes([*range(64), 62, 63]))


class Signs:
    """Base64 signs, which can be read as bytes from any sign on; what was found about nested values at a place is kept, as many starts can share them."""

    def __init__(self, signs: str):
        self.values = signs.encode().translate(SIX)
        self.known: dict[tuple[int, int, int], bool] = {}

    def view(self, at: int, size: int) -> View:
        return View(self, 6 * at, size)


class View:
    """Bytes within signs, decoded where they are looked at."""

    def __init__(self, signs: Signs, bit: int, size: int):
        self.signs, self.bit, self.size = signs, bit, size

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, i):
        if isinstance(i, slice):
            start, stop, _ = i.indices(self.size)
            return View(self.signs, self.bit + 8 * start, max(0, stop - start))
        if not 0 <= i < self.size:
            raise IndexError(i)
        at, shift = divmod(self.bit + 8 * i, 6)
        values = self.signs.values
        three = values[at] << 12 | values[at + 1] << 6 | (values[at + 2] if at + 2 < len(values) else 0)
        return three >> (10 - shift) & 0xFF

    def __bytes__(self) -> bytes:
        return bytes(self[i] for i in range(self.size))


def few(data: bytes | View, most: int = 64) -> bytes:
    """The data, or its first bytes and one more than can be asked for."""
    return bytes(data[: most + 1])


def der_head(data: bytes | View, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start, stop) of the content of the DER value at `at`; the content may reach beyond what data holds, not beyond end."""
    if at + 2 > min(end, len(data)):
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if tag & 0x1F == 0x1F or tag == 0:
        return None
    if size >= 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or at + n > len(data) or data[at] == 0:
            return None
        size, at = int.from_bytes(bytes(data[at : at + n]), "big"), at + n
        if size < 0x80:
            return None
    return None if at + size > end else (tag, at, at + size)


def der_fits(data: bytes | View, at: int, end: int, depth: int) -> bool:
    """Whether DER values fill data[at:end] exactly, remembered for views."""
    if not isinstance(data, View):
        return der_parts(data, at, end, depth) is not None
    key = (data.bit + 8 * at, end - at, depth)
    if key not in data.signs.known:
        data.signs.known[key] = der_parts(data, at, end, depth) is not None
    return data.signs.known[key]


def der_parts(data: bytes | View, at: int, end: int, depth: int = 0, most: int | None = None) -> list[tuple[int, int, int]] | None:
    """The DER values that fill data[at:end] exactly, as do the parts of constructed ones; None if they don't, or are more than `most`."""
    out = []
    while at < end:
        one = der_head(data, at, end)
        if one is None or one[0] == INTEGER and one[1] == one[2] or len(out) == most:
            return None
        if one[0] & 0x20 and (depth == DEPTH or not der_fits(data, one[1], one[2], depth + 1)):
            return None
        out.append(one)
        at = one[2]
    return out


def der_size(head: bytes | None) -> int:
    """The size that the first bytes of a private key in DER state, itself included; zero if what of them is at hand can't be one's."""
    one = der_head(head, 0, 1 << 32) if head else None
    if one is None or one[0] != SEQUENCE:
        return 0
    first = der_head(head, one[1], one[2])
    # a version comes first, or of encrypted keys the algorithm
    if first is None or first[0] not in (INTEGER, SEQUENCE) or first[0] == INTEGER and (first[2] - first[1] != 1 or head[first[1] : first[2]] not in (b"", b"\0", b"\1")):
        return 0
    at = one[1]
    while at + 6 <= min(one[2], len(head)):
        part = der_head(head, at, one[2])
        if part is None or part[0] & 0x20 and part[2] <= len(head) and der_parts(head, part[1], part[2]) is None:
            return 0
        at = part[2]
    return one[2]


def is_private_key(data: bytes | View | None) -> bool:
    """Whether data is exactly one private key in DER: PKCS#1, DSA, SEC1, or PKCS#8, plain or encrypted."""
    top = der_head(data, 0, len(data)) if data is not None else None
    if top is None or top[0] != SEQUENCE or top[2] != len(data):
        return False
    parts = der_parts(data, top[1], top[2], most=10) or []  # no key has more
    tags, held = [t for t, _, _ in parts], [data[a:b] for _, a, b in parts]
    if tags[:1] == [INTEGER]:
        version = int.from_bytes(bytes(held[0]), "big", signed=True) if len(held[0]) <= 64 else -1
        if set(tags) == {INTEGER}:
            return len(tags) == 9 and version == 0 or len(tags) == 6 and version == 0
        if tags == [INTEGER] * 9 + [SEQUENCE]:
            return version == 1
        if tags[:2] == [INTEGER, OCTETS]:
            return version == 1 and len(held[1]) >= 16 and tags[2:] in ([], [0xA0], [0xA1], [0xA0, 0xA1])
        if tags[:3] == [INTEGER, SEQUENCE, OCTETS]:
            return version in (0, 1) and tags[3:] in ([], [0xA0], [0xA1], [0x81], [0xA0, 0xA1], [0xA0, 0x81]) and holds_key(held[1], held[2])
        return False
    if tags == [SEQUENCE, OCTETS]:
        algorithm = der_parts(held[0], 0, len(held[0]), most=2) or []
        return [t for t, _, _ in algorithm] == [OID, SEQUENCE] and few(held[0][algorithm[0][1] : algorithm[0][2]]).startswith(PASSWORD_BASED) and len(held[1]) >= 16
    return False


def holds_key(algorithm: bytes | View, octets: bytes | View) -> bool:
    """Whether the octets are a key of the algorithm (any, if it is an unknown one)."""
    parts = der_parts(algorithm, 0, len(algorithm))
    if not parts or parts[0][0] != OID or not len(octets):
        return False
    name = few(algorithm[parts[0][1] : parts[0][2]])
    if name in (RSA, EC):
        # a version, then the modulus or the key itself
        top = der_head(octets, 0, len(octets))
        return is_private_key(octets) and der_parts(octets, top[1], top[2])[1][0] == (INTEGER if name == RSA else OCTETS)
    if name == DSA or name in EDWARDS:
        inner = der_head(octets, 0, len(octets))
        fits = inner is not None and inner[2] == len(octets) and inner[0] == (INTEGER if name == DSA else OCTETS)
        return fits and (name == DSA or inner[2] - inner[1] == EDWARDS[name])
    return True


def ssh_field(data: bytes, at: int) -> int:
    """The end of the length-prefixed field at `at`; -1 if it goes beyond the data."""
    stop = at + 4 + int.from_bytes(data[at : at + 4], "big")
    return stop if at + 4 <= stop <= len(data) and at + 4 <= len(data) else -1


def is_openssh(data: bytes | None) -> bool:
    """Whether data is an OpenSSH private key, read to its end."""
    if not data or not data.startswith(OPENSSH):
        return False
    at, fields = len(OPENSSH), []
    for n in range(3):  # cipher, key derivation, its options; then a count
        stop = ssh_field(data, at)
        if stop < 0:
            return False
        fields.append(data[at + 4 : stop])
        at = stop
    count, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    if not 1 <= count <= 64:
        return False
    for _ in range(count + 1):  # public keys, then the private section
        start, at = at, ssh_field(data, at)
        if at < 0:
            return False
    section = data[start + 4 : at]
    tag = 16 if re.search(rb"gcm|poly1305", fields[0]) else 0
    if at + tag != len(data) or not section or len(section) % 8:
        return False
    if fields[0] != b"none":
        return True
    if section[:4] != section[4:8]:
        return False
    at, seen = 8, 0
    while at < len(section) and section[at:] != bytes(range(1, len(section) - at + 1)):
        at, seen = ssh_field(section, at), seen + 1
        if at < 0:
            return False
    return seen >= 3 * count and len(section) - at < 256


def json_object(part: str) -> dict | None:
    """The JSON object that base64url of a token's part holds."""
    data = unbase64(part)
    if not data or data[:1] != b"{" or data.rstrip()[-1:] != b"}":
        return None
    try:
        found = json.loads(data)
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def token_parts(parts: list[str]) -> int:
    """Of how many of the parts a token consists: five (encrypted), three (signed) or none."""
    # a header is text from its first bytes on
    head = json_object(parts[0]) if (unbase64(parts[0][:64]) or b"\xff").isascii() else None
    if head is None or not isinstance(head.get("alg"), str):
        return 0
    if len(parts) >= 5 and parts[4] and isinstance(head.get("enc"), str):
        return 5
    return 3 if (parts[2] or head["alg"].lower() == "none") and json_object(parts[1]) is not None else 0


def heads(part: str) -> list[int]:
    """Where a token's header can begin in a part: at the signs of a JSON object that ends where the part does.

    The part is decoded once for each alignment. Whether a brace is in a string follows from the number of quotes since the object's
    start, so for either parity one pass with a stack tells the brace that the last one closes.
    """
    found = [m.start() for m in HEAD.finditer(part)]
    if len(found) < 2:
        return found
    out = []
    for first in range(4):
        own = {(at - first) // 4 * 3: at for at in found if at % 4 == first}
        data = unbase64(part[first:]) if own else None
        data = (data or b"").rstrip()
        if data[-1:] != b"}":
            continue
        inside, opened = 0, ([], [])
        for m in re.finditer(rb'(\\*)(["{}])', data):
            if m[2] == b'"':
                inside ^= len(m[1]) % 2 == 0  # else it is escaped
            elif m[2] == b"{":
                opened[inside].append(m.start(2))
            elif opened[inside]:
                start = opened[inside].pop()
                if m.end() == len(data) and start in own:
                    out.append(own[start])
    return sorted(out)


def tokens(text: str) -> list[tuple[int, int]]:
    """(start, end) of the tokens: in each run of dotted parts, five or three from a part on; what stands before a header's sign is left out."""
    out = []
    for run in DOTTED.finditer(text):
        if "eyJ" not in run[0]:
            continue
        parts, at, i = run[0].split("."), run.start(), 0
        while i < len(parts) - 2:
            used = 1
            for head in heads(parts[i]):
                tried = [parts[i][head:], *parts[i + 1 : i + 5]]
                if n := token_parts(tried):
                    out.append((at + head, at + head + len(".".join(tried[:n]))))
                    used = n
                    break
            at += sum(len(p) + 1 for p in parts[i : i + used])
            i += used
    return out


def pem_blocks(text: str) -> list[tuple[int, int]]:
    """(start, end) of private-key blocks: each BEGIN mark with the END mark that follows next, if it has the same label."""
    out, begin = [], None
    for m in PEM_MARK.finditer(text):
        if m[1] == "BEGIN":
            begin = m
            continue
        if begin and begin[2] == m[2]:
            body = PEM_JOINT.sub(lambda e: "/" if e[0].endswith("/") else "\n", text[begin.end() : m.start()])
            plain = PEM_HEADER.sub("", body)
            data = unbase64(plain) if PEM_BODY.fullmatch(plain) else None
            cipher = ENCRYPTED.search(body)
            if is_private_key(data) or is_openssh(data) or data and "ENCRYPTED" in body and cipher and len(data) % (len(cipher[1]) // 2) == 0:
                out.append((begin.start(), m.end()))
        begin = None
    return out


def key_at(signs: str, read: Signs | None, at: int, edge) -> tuple[int, int] | None:
    """(end, kind's number) of the key whose base64 begins at `at` of the signs and ends at an edge (a function of the end); None if there is none.

    DER's heads are read in place, so a start costs what heads it has, whatever sizes they state.
    """
    if signs[at] == "M":
        size = der_size(unbase64(signs[at : at + 64]))
        end = at + (size * 4 + 2) // 3
        return (end, 5) if at < end <= len(signs) and edge(end) and is_private_key(read.view(at, size)) else None
    return (len(signs), 6) if is_openssh(unbase64(signs[at:])) else None


def wrapped(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of base64 in two or more lines whose bytes are a private key."""
    out = []
    for block in LINES.finditer(text):
        body = block[0]
        # escaped line ends become blanks of the same length, so that their letters are no part of a line
        lines = [(m.start(), m.end()) for m in re.finditer(r"\S+", re.sub(r"\\++[rn](?:\\++n)?", lambda e: " " * len(e[0]), body))]
        signs = [body[a:b].rstrip("=") for a, b in lines]
        ends = list(accumulate(len(x) for x in signs))
        whole, at = "".join(signs), 0
        read = Signs(whole)
        while at < len(lines) - 1:
            before, found = ends[at] - len(signs[at]), None
            line = lambda end: bisect_left(ends, end)
            if signs[at][0] == "M":
                found = key_at(whole, read, before, lambda end: line(end) > at and ends[line(end)] == end)  # noqa: B023
            elif signs[at].startswith("b3BlbnNzaC1rZXktdjEA"):
                i = at + 1  # lines of one width, and a shorter one
                while i < len(lines) and len(signs[i]) == len(signs[at]):
                    i += 1
                for last in (i, i - 1):
                    if at < last < len(lines) and len(signs[last]) <= len(signs[at]):
                        found = found or key_at(whole[: ends[last]], None, before, None)
                at = max(at, i - 2) if found is None else at
            if found is None:
                at += 1
            else:
                last = line(found[0])
                out.append((block.start() + lines[at][0], found[1], block.start() + lines[last][1]))
                at = last + 1
    return out


def single(run: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the keys in one run of base64 signs."""
    out, free, magic = [], 0, True
    signs = run.rstrip("=")
    read = None
    edge = lambda end: end == len(signs) or signs[end] in "+/_-"
    for m in BEGIN.finditer(signs):
        if m.start() < free or not (magic or m[0][0] == "M"):
            continue
        read = read or Signs(signs)
        found = key_at(signs, read, m.start(), edge)
        magic &= m[0][0] == "M"  # what follows OpenSSH's magic is one key or none
        if found:
            free = len(run) if found[0] == len(signs) else found[0]
            out.append((m.start(), found[1], free))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end), unsorted."""
    out = []
    if ASSIGN_HINT.search(text.encode().lower()):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    return out + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def confirmed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the spans that the method adds; keys within a block or within lines aren't listed again."""
    out = [(a, 3, b) for a, b in tokens(text)] if "eyJ" in text else []
    covered = pem_blocks(text) if "PRIVATE KEY-----" in text else []
    out += [(a, 4, b) for a, b in covered]

    def uncovered(found):
        starts = [a for a, _ in covered]
        return [x for x in found if not (i := bisect_right(starts, x[0])) or covered[i - 1][1] <= x[0]]

    lined = uncovered(wrapped(text))
    covered = sorted(covered + [(a, b) for a, _, b in lined])
    runs = [(a + m.start(), kind, b + m.start()) for m in RUN.finditer(text) for a, kind, b in single(m[0])]
    runs += [(m.start(), 5, m.end()) for m in HEX_RUN.finditer(text) if not len(m[0]) % 2 and is_private_key(bytes.fromhex(m[0]))]
    return out + lined + uncovered(runs)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, spans array<struct<kind,start,end>> in order."""

    def make():
        def work(keys, texts):
            found = []
            for t in texts:
                found.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in sorted(base_spans(t) + confirmed_spans(t))])
            return [found]

        return work

    return map_texts(docs, key, text, make, "spans array<struct<kind:string,start:int,end:int>>")


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_assign, n_access, n_hex, base_sha256, spans: the counts and the digest of the base spans, and all spans."""
    spans = scan(docs, key, text)
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    joined = lambda a: F.array_join(F.transform(a, one), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*LEAST))
    return spans.select(key, *[count(k) for k in LEAST], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with each secret span (overlapping ones joined) in the text replaced by the mark; all columns, order and rows stay.

    A null text stays null.
    """

    def one(t):
        spans = sorted(base_spans(t) + confirmed_spans(t)) if t else []
        if not spans:
            return t
        out, at, end = [], 0, -1
        for a, _, b in spans:
            if a > end:
                if end >= 0:
                    out.append(mark)
                    at = end
                out.append(t[at:a])
                end = b
            else:
                end = max(end, b)
        return "".join([*out, mark, t[end:]])

    return pass_rows(docs, text, lambda: lambda texts: [one(t) for t in texts], False)
