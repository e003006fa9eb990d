"""Secrets in texts: keywords by one automaton, anchored patterns where it hits, checksums that tokens carry.

A text is read once by an Aho-Corasick automaton of all keywords. A pattern is tried only at a hit, anchored there, so
a text without keywords costs one pass and no pattern. Runs of hexadecimal digits have no keyword of their own; any of
GRAM digits in a row is one for them, and the run around a hit is measured.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The base kinds, in the order in which spans of one start are listed; the checked kinds follow.
BASE_KINDS = ("assign", "access", "hex")
CHECKED_KINDS = ("github", "npm", "xprv", "wif", "age", "nostr")
KINDS = BASE_KINDS + CHECKED_KINDS
#: Hexadecimal digits in a row that count as a hit, and the least run.
GRAM, LEAST_HEX = 4, 24
LEAST_ACCESS, LEAST_VALUE = 20, 6

#: Fixed values. Words before an assigned secret; prefixes of tokens with a checksum; words before a wallet's key.
ASSIGNED = ("password", "passwd", "secret", "token", "apikey", "api_key")
PREFIXES = {"akia": "access", "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm", "xprv": "xprv", "age-secret-key-1": "age", "nsec1": "nostr"}
WALLET_WORDS = ("wif", "privkey", "private key", "private_key", "bitcoin")
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
BECH32_STEPS = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)

_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
#: Tokens of a fixed length end where their alphabet does.
_TOKENS = {
    "github": re.compile(r"gh[pousr]_[0-9A-Za-z]{36}(?![0-9A-Za-z_])"),
    "npm": re.compile(r"npm_[0-9A-Za-z]{36}(?![0-9A-Za-z_])"),
    "xprv": re.compile(r"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![0-9A-Za-z])"),
    "age": re.compile(r"(?:AGE-SECRET-KEY-1[02-9AC-HJ-NP-Z]{58}|age-secret-key-1[02-9ac-hj-np-z]{58})(?![0-9A-Za-z])"),
    "nostr": re.compile(r"nsec1[02-9ac-hj-np-z]{58}(?![0-9A-Za-z])"),
}
#: A wallet's key stands within so many characters after its word.
NEAR = 24
_WIF = re.compile(rf"[^0-9A-Za-z](?:.{{0,{NEAR}}}?[^0-9A-Za-z])??([5KL][1-9A-HJ-NP-Za-km-z]{{50,51}})(?![0-9A-Za-z])", re.DOTALL)
_LOWER = {k: k + 32 for k in range(65, 91)}


def base62_crc_holds(body: str) -> bool:
    """Whether the last six characters are the CRC-32 of those before, in base 62."""
    crc, out = zlib.crc32(body[:-6].encode()), ""
    while crc:
        crc, digit = divmod(crc, 62)
        out = BASE62[digit] + out
    return out.rjust(6, "0") == body[-6:]


def base58_check_holds(key: str) -> bool:
    """Whether the last four bytes of a base 58 number are the double SHA-256 of those before."""
    number = 0
    for c in key:
        number = number * 58 + BASE58.index(c)
    raw = number.to_bytes((number.bit_length() + 7) // 8, "big")
    raw = b"\0" * (len(key) - len(key.lstrip("1"))) + raw
    return len(raw) > 4 and hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def bech32_holds(key: str) -> bool:
    """Whether the last six characters make the polynomial checksum of prefix and data one."""
    prefix, _, data = key.lower().rpartition("1")
    values = [ord(c) >> 5 for c in prefix] + [0] + [ord(c) & 31 for c in prefix] + [BECH32.index(c) for c in data]
    sum_ = 1
    for v in values:
        top, sum_ = sum_ >> 25, (sum_ & 0x1FFFFFF) << 5 ^ v
        for k, step in enumerate(BECH32_STEPS):
            if top >> k & 1:
                sum_ ^= step
    return sum_ == 1


_CHECKS = {"github": lambda t: base62_crc_holds(t[4:]), "npm": lambda t: base62_crc_holds(t[4:]), "xprv": base58_check_holds, "age": bech32_holds, "nostr": bech32_holds}


@lru_cache(1)
def automaton() -> ahocorasick.Automaton:
    """All keywords in lower case, each with what is tried at its hits and its length."""
    out = ahocorasick.Automaton()
    for gram in product("0123456789abcdef", repeat=GRAM):
        out.add_word("".join(gram), ("hex", GRAM))
    for word in ASSIGNED:
        out.add_word(word, ("assign", len(word)))
    for word in WALLET_WORDS:
        out.add_word(word, ("wif", len(word)))
    for word, kind in PREFIXES.items():
        out.add_word(word, (kind, len(word)))
    out.make_automaton()
    return out


def lowered(text: str) -> str:
    """A-Z in lower case and nothing else changed, so positions stay."""
    return text.lower() if text.isascii() else text.translate(_LOWER)


def spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(start, kind, end) of the base spans, and of those added by checksum, in order of start, then kind.

    Base spans of a kind are leftmost and don't overlap; a match that its kind's least length drops isn't tried again.
    A match has to begin at a hit, and hits of a kind come in order of their starts, so none is passed over. A hit
    within the match before costs nothing, so a long run costs its length once.
    """
    base: list[tuple[int, int, int]] = []
    added: set[tuple[int, int, int]] = set()
    done = dict.fromkeys(BASE_KINDS, 0)
    for last, (kind, size) in automaton().iter(lowered(text)):
        start = last + 1 - size
        if kind == "hex":
            if start >= done["hex"] and (m := _HEX.match(text, start)):  # the first hit that lies in a run is at its start
                done["hex"] = m.end()
                if m.end() - start >= LEAST_HEX:
                    base.append((start, 2, m.end()))
        elif kind == "assign":
            if start >= done["assign"] and (m := _ASSIGN.match(text, start)):
                done["assign"] = m.end()
                if len(m[1]) >= LEAST_VALUE:
                    base.append((start, 0, m.end()))
        elif kind == "access":
            if start >= done["access"] and (m := _ACCESS.match(text, start)):
                done["access"] = m.end()
                if m.end() - start >= LEAST_ACCESS:
                    base.append((start, 1, m.end()))
        elif kind == "wif":
            if (m := _WIF.match(text, last + 1)) and base58_check_holds(m[1]):
                added.add((m.start(1), KINDS.index("wif"), m.end(1)))
        elif start == 0 or not (text[start - 1].isascii() and text[start - 1].isalnum()):
            if (m := _TOKENS[kind].match(text, start)) and _CHECKS[kind](m[0]):
                added.add((start, KINDS.index(kind), m.end()))
    return sorted(base), sorted(added)


def _told(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_added, base, spans), one row for each input row, in one pass and no shuffle.

    Counts by kind are of base spans. `base` and `spans` are lists kind:start:end in order of start, then kind, offsets in
    code points, ends exclusive; `spans` has the base and, in n_added, tokens whose own checksum holds: GitHub and npm
    tokens, extended and wallet keys, age and Nostr keys. A null or empty text has no spans; a null id is carried
    along; rows that repeat an id or a text get results of their own; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, base_told, told = [[] for _ in range(4)], [], []
            for text in batch.column(1):  # one text at a time is a Python string
                base, added = spans(text.as_py() or "")
                for k in range(3):
                    counts[k].append(sum(x[1] == k for x in base))
                counts[3].append(len(added))
                base_told.append(_told(base))
                told.append(_told(sorted(base + added)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(base_told, pa.string()), pa.array(told, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "n_added", "base", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_added long, base string, spans string")
