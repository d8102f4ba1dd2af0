"""Plain single-process versions of the contracts, for comparison on small tables."""

import base64
import hashlib
import re
import zlib

import public_tokenizers
import tiktoken
import xxhash
from tokenizers import Tokenizer


def sha(x: str | bytes) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def ascii_lower(t: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def equal_groups(docs):
    """docs: (doc_id, text) pairs. doc_id -> (keep_id, size, kept, sha)."""
    groups = {}
    for i, t in docs:
        groups.setdefault(ascii_lower(t or ""), []).append(i)
    return {i: (max(g), len(g), i == max(g), sha(t)) for t, g in groups.items() for i in g}


def simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_groups(docs, radius=2):
    """doc_id -> (fingerprint, smallest reachable doc_id)."""
    prints = {i: simhash(t) for i, t in docs}
    by = {}
    for i, p in prints.items():
        by.setdefault(p, []).append(i)
    keys = list(by)
    root = {p: p for p in keys}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for n, a in enumerate(keys):
        for b in keys[:n]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    low = {}
    for p in keys:
        low[find(p)] = min(low.get(find(p), min(by[p])), min(by[p]))
    return {i: (f"{p:016x}", low[find(p)]) for i, p in prints.items()}


_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(docs, items, window=13):
    """doc_id -> (n_words, n_hit, n_items, sha of the items, contaminated)."""
    wanted = {}
    for item, t in items:
        w = _WORD.findall(ascii_lower(t or ""))
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if size and item is not None else 0):
            wanted.setdefault(tuple(w[i:i + size]), set()).add(str(item))
    sizes = {len(w) for w in wanted}
    out = {}
    for d, t in docs:
        w = _WORD.findall(ascii_lower(t or ""))
        hit, names = set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if (found := wanted.get(tuple(w[i:i + k]))):
                    hit.update(range(i, i + k))
                    names |= found
        out[d] = (len(w), len(hit), len(names), sha(",".join(sorted(names))), bool(hit) and 20 * len(hit) >= len(w))
    return out


def byte_bpe():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def bpe_digests(docs):
    import numpy as np

    enc, out = byte_bpe(), {}
    for d, t in docs:
        ids = enc.encode_ordinary(t or "")
        out[d] = (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(enc.decode_bytes(ids)))
    return out


def id_files(docs):
    """doc_id -> (start, n_tokens, crc); doc ids must differ."""
    import numpy as np

    tok, out, at = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), {}, 0
    for d, t in sorted(docs):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        out[d] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    return out


def spans_digest(kinds, found):
    ordered = sorted(found, key=lambda s: (s[1], kinds.index(s[0])))
    text = ",".join(f"{k}:{a}:{b}" for k, a, b in ordered)
    return tuple(sum(k == kind for k, *_ in found) for kind in kinds) + (sha(text), text)


def secrets(text):
    text, found = text or "", []
    assign = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|"""
                        r"""[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    found += [("assign", *m.span()) for m in assign.finditer(text) if len(m[2]) >= 8]
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return spans_digest(("assign", "access", "hex"), found)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def personal(text):
    text, found = text or "", []

    def digits(m):
        return re.sub("[^0-9]", "", m[0])

    found += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    found += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15]
    return spans_digest(("email", "ip", "card", "phone"), found)
