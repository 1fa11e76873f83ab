"""What the operators on token ids share: the families of tokenizer files whose split patterns are followed here in numpy, and how a batch of texts is cut into their words.

Texts are taken as UTF-8 bytes of a whole batch. Each byte gets the class of its character: letter, number, other, white space, or odd (beyond U+024F, control characters, and what could be a special token). A chunk between white space that holds an odd character is one unit, left to the library's parts; all else is cut as the family's pattern does:

* `spaced`, byte-level BPE: a word takes one space before it; of white space before a word all but the last character is one word;
* `dropped`, BPE with word ends: lower case, white space dropped, each number character on its own.

In both, an apostrophe and s, t, re, ve, m, ll or d are a word where the pattern comes to the apostrophe by itself.
"""

from __future__ import annotations

import unicodedata

import numpy as np

ODD, LETTER, NUMBER, OTHER, SPACE, CHUNK = range(6)
#: Bytes of the largest piece of a text that is cut at once; longer texts are divided where a space stands between letters.
PIECE = 4_000_000


def _class(c: str) -> int:
    """Class of a character; U+0130, U+023A and U+023E are odd since their lower case is of another length."""
    if c in " \t\n\v\f\r":
        return SPACE
    kind = unicodedata.category(c)[0]
    if ord(c) >= 0x250 or ord(c) in (0x130, 0x23A, 0x23E) or kind == "C" or c.isspace():
        return ODD
    return {"L": LETTER, "N": NUMBER}.get(kind, OTHER)


#: By byte, for ASCII; by code point below U+0250, for what UTF-8 writes as two bytes.
ONE_BYTE = np.array([_class(chr(b)) if b < 128 else ODD for b in range(256)], np.uint8)
TWO_BYTES = np.array([ODD] * 128 + [_class(chr(c)) for c in range(128, 0x250)], np.uint8)
LOWER_ONE = np.array([ord(chr(b).lower()) if b < 128 else b for b in range(256)], np.uint8)
LOWER_TWO = np.array([ord(chr(c).lower()) if len(chr(c).lower()) == 1 and ord(chr(c).lower()) < 0x250 else c for c in range(0x250)], np.uint16)


def byte_letters() -> str:
    """The 256 characters that stand for bytes in byte-level vocabularies: printable bytes for themselves, others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return "".join(chr(b) if b in shown else chr(next(spare)) for b in range(256))


BYTE_LETTERS = byte_letters()
_TO_BYTES = {ord(c): b for b, c in enumerate(BYTE_LETTERS)}


def spelled(word: str) -> bytes:
    """The bytes of a word in characters of the vocabulary."""
    return word.translate(_TO_BYTES).encode("latin-1")


def family(made: dict) -> str | None:
    """'spaced' or 'dropped' for the two families whose patterns cut() follows, else None."""
    split, normal, model = made.get("pre_tokenizer") or {}, made.get("normalizer"), made["model"]
    if model.get("type", "BPE") != "BPE" or any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")):
        return None
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or not t["content"].startswith("<|") or any(c.isspace() for c in t["content"]) for t in made.get("added_tokens", [])):
        return None
    if split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and normal is None and not model.get("end_of_word_suffix"):
        return "spaced"
    steps = split.get("pretokenizers", [])
    if len(steps) == 2 and steps[0] == DROPPED_SPLIT and steps[1].get("type") == "ByteLevel" and not steps[1].get("use_regex") and not steps[1].get("add_prefix_space") and normal == DROPPED_NORMALIZER and model.get("end_of_word_suffix"):
        return "dropped"
    return None


#: What a tokenizer file of the second family says, fixed values.
DROPPED_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
DROPPED_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}


def lowered(data: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """Bytes in lower case; lead are the places of the first of two bytes."""
    low = LOWER_ONE[data]
    if len(lead):
        code = (data[lead].astype(np.int64) & 31) << 6 | (data[lead + 1] & 63)
        code = LOWER_TWO[code]
        low[lead], low[lead + 1] = 0xC0 | code >> 6, 0x80 | code & 63
    return low


def cut(data: np.ndarray, rows: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts of the family `kind`: text i is data[rows[i]:rows[i + 1]]. Bytes as they count (lower case if dropped), start and end of each unit in order, and whether it is an odd chunk."""
    n = len(data)
    size = ONE_BYTE[data]
    lead = np.nonzero((data >= 0xC2) & (data <= 0xC9))[0]
    lead = lead[lead + 1 < n]
    if len(lead):
        code = (data[lead].astype(np.int64) & 31) << 6 | (data[lead + 1] & 63)
        size[lead] = size[lead + 1] = np.where(code < 0x250, TWO_BYTES[np.minimum(code, 0x24F)], ODD)
    kinds = size
    kinds[:-1][(data[:-1] == 0x3C) & (data[1:] == 0x7C)] = ODD
    low = lowered(data, lead) if kind == "dropped" else data
    first = np.zeros(n + 1, bool)  # where a text starts, and the end
    first[rows] = True
    first[n] = True
    space = kinds == SPACE
    after_space = np.zeros(n, bool)
    after_space[1:] = space[:-1]
    after_space |= first[:n]
    before_space = np.ones(n, bool)
    before_space[:-1] = space[1:]
    before_space |= first[1:]
    if (kinds == ODD).any():
        opens, closes = ~space & after_space, ~space & before_space
        chunk = np.cumsum(opens) - 1
        bad = np.unique(chunk[kinds == ODD])
        step = np.zeros(n + 1, np.int8)
        step[np.nonzero(opens)[0][bad]] = 1
        step[np.nonzero(closes)[0][bad] + 1] -= 1
        kinds[np.cumsum(step[:-1], dtype=np.int8) > 0] = CHUNK
    begins = np.ones(n, bool)
    begins[1:] = kinds[1:] != kinds[:-1]
    begins |= first[:n]
    begins &= ~space
    if kind == "dropped":
        begins |= (kinds == NUMBER) & (data & 0xC0 != 0x80)
    quote = np.nonzero((data == 0x27) & begins & (kinds == OTHER))[0]
    quote = quote[quote + 1 < n]
    quote = quote[(kinds[quote + 1] == LETTER) & ~first[quote + 1]]
    if kind == "spaced":
        quote = quote[first[quote] | (data[quote - 1] != 0x20)]
    if len(quote):
        one, far = low[quote + 1], np.minimum(quote + 2, n - 1)
        two = np.where((quote + 2 < n) & ~first[far] & (kinds[far] == LETTER), low[far], 0)
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        begins[quote[short | long] + 1] = False
        end = np.concatenate([quote[short] + 2, quote[long] + 3])
        end = end[end < n]
        begins[end[(kinds[end] == LETTER) & ~first[end]]] = True
    start = np.nonzero(begins)[0]
    last = before_space.copy()
    last[:-1] |= begins[1:]
    end = np.nonzero(last & ~space)[0] + 1
    odd = kinds[start] == CHUNK
    if kind == "spaced":
        start = start - (~first[start] & (data[start - 1] == 0x20))
        opens, closes = np.nonzero(space & (~np.append(False, space[:-1]) | first[:n]))[0], np.nonzero(space & (~np.append(space[1:], False) | first[1:]))[0] + 1
        final = first[closes]
        alone = ~final & (data[closes - 1] != 0x20)
        more = ~final & (closes - opens > 1)
        start = np.concatenate([start, opens[final], opens[more], closes[alone] - 1])
        end = np.concatenate([end, closes[final], closes[more] - 1, closes[alone]])
        odd = np.append(odd, np.zeros(len(start) - len(odd), bool))
        order = np.argsort(start, kind="stable")
        start, end, odd = start[order], end[order], odd[order]
    return low, start, end, odd


def divided(data: np.ndarray, rows: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Texts as pieces of about `piece` bytes at most: their bounds, and the number of the text that each belongs to. A text is divided before a space between two ASCII letters, so that its words stay as they are."""
    bounds, owner = [0], []
    for i, (a, b) in enumerate(zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)):
        while b - a > piece:
            for lo in range(a + piece // 2, b - 1, piece):
                window = data[lo : min(lo + piece, b)]
                kinds = ONE_BYTE[window]
                at = np.nonzero((window[1:-1] == 0x20) & (kinds[:-2] == LETTER) & (kinds[2:] == LETTER))[0]
                if len(at):
                    a = lo + 1 + int(at[0])
                    bounds.append(a)
                    owner.append(i)
                    break
            else:
                break
        bounds.append(b)
        owner.append(i)
    return np.array(bounds, np.int64), np.array(owner, np.int64)


def ids_of(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, "<u4")


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
