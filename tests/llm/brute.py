"""Plain statements of what the operators must give, for small tables."""

import hashlib
import re
import struct
import zlib
from collections import defaultdict


def sha1(b):
    return hashlib.sha1(b).hexdigest()


def warc(pages):
    """{page_id: (bytes, digest, type, refers_to)}"""
    last, out = defaultdict(int), {}
    for i, h in pages:
        b = (h or "").encode()
        if len(b) >= 1000:
            last[b] = max(last[b], i)
    for i, h in pages:
        b = (h or "").encode()
        to = last[b] if len(b) >= 1000 and last[b] != i else None
        out[i] = (len(b), sha1(b), "response" if to is None else "revisit", to)
    return out


def fingerprint(text):
    import xxhash

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    s = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def components(prints, most=2):
    """{doc_id: (fp, smallest reachable id)}"""
    ids = sorted(prints)
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= most:
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (prints[i], root(i)) for i in ids}


def repeats(docs, length=100):
    """{doc_id: (bytes, removed, spans, sha256 of what stays)}"""
    seen, out = {}, {}
    raw = {i: (t or "").encode() for i, t in docs}
    for i in sorted(raw):
        for s in range(len(raw[i]) - length + 1):
            seen.setdefault(raw[i][s : s + length], (i, s))
    for i, b in raw.items():
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] < (i, s):
                gone[s : s + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def luhn(d):
    s = [int(c) for c in reversed(d)]
    return sum(s[0::2] + [x * 2 // 10 + x * 2 % 10 for x in s[1::2]]) % 10 == 0


def personal(text):
    """Counts by kind and the digest of the base spans."""
    t, found = text or "", []
    kinds = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    for n, (kind, pattern) in enumerate(kinds.items()):
        for m in re.finditer(pattern, t):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and not all(int(p) <= 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 10 <= len(d) <= 15:
                continue
            found.append((m.start(), n, f"{kind}:{m.start()}:{m.end()}"))
    said = [x for _, _, x in sorted(found)]
    return [sum(x.startswith(k) for x in said) for k in kinds], hashlib.sha256(",".join(said).encode()).hexdigest(), said


def pieces(docs, tokenizer, space=4096):
    """[(doc_id, piece, start, length, crc)]"""
    out = []
    for i, t in docs:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), space):
            p = ids[k : k + space]
            out.append((i, k // space, k, len(p), zlib.crc32(struct.pack(f"<{len(p)}I", *p))))
    return out
