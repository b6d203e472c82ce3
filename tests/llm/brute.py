"""Plain Python versions of the corpus operators, for small tables."""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def fingerprint(text: str | None) -> int:
    words = WORD.findall(lower(text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints: list[int], distance: int = 3) -> list[int]:
    """A group number for each fingerprint, equal where links of at most ``distance`` bits reach."""
    group = list(range(len(prints)))
    for i, j in itertools.combinations(range(len(prints)), 2):
        if group[i] != group[j] and (prints[i] ^ prints[j]).bit_count() <= distance:
            old, new = group[i], group[j]
            group = [new if g == old else g for g in group]
    return group


def components(ids: list, prints: list[int], distance: int = 3) -> list:
    """Smallest id reachable from each row."""
    low, group = {}, groups(prints, distance)
    for i, g in zip(ids, group, strict=True):
        if i is not None:
            low[g] = min(low.get(g, i), i)
    return [low.get(g) for g in group]


def bench_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))


def contamination(text: str | None, items: list[tuple]) -> tuple:
    """n_words, n_hit, n_items, items_sha256, contaminated."""
    words, hit, seen = bench_words(text), set(), set()
    for item, item_text in items:
        own = bench_words(item_text)
        n = min(13, len(own))
        windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in windows:
                hit.update(range(i, i + n))
                seen.add(str(item))
    digest = hashlib.sha256(",".join(sorted(seen)).encode()).hexdigest()
    return len(words), len(hit), len(seen), digest, bool(hit) and 20 * len(hit) >= len(words)


def measures(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count, covered = Counter(windows), set()
    for i, window in enumerate(windows):
        if count[window] > 1:
            covered.update((i, i + 1, i + 2))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)), len(covered),
        len(words) < 50 or 100 * len(covered) > 50 * len(words),
    )


def without_repeats(rows: list[tuple], length: int = 50) -> list[tuple]:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of each (id, text)."""
    least: dict[bytes, int] = {}
    for i, text in rows:
        raw = (text or "").encode()
        if i is not None:
            for s in range(len(raw) - length + 1):
                w = raw[s : s + length]
                least[w] = min(least.get(w, i), i)
    out = []
    for i, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - length + 1) if i is not None else ():
            if least[raw[s : s + length]] < i:
                gone[s : s + length] = b"\1" * length
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check_packing(pieces: list[dict], docs: list[tuple], encode, size: int = 1024) -> float:
    """Every id of every document lies in one piece, sequences are gapless; returns the padding's share.

    Rows of one id are told apart by their ids' checksums, so ids must be unique here.
    """
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    assert set(by_doc) == {i for i, _ in docs}
    for i, text in docs:
        ids = np.array([*encode(text or ""), 0], "<u4")
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p["start"]):
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    used = padding = 0
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= size
        used += at
        padding += 0 if at & (at - 1) == 0 else size - at
    return padding / max(used, 1)


def conversation(turns: list[tuple]) -> tuple:
    """n_turns, turns_sha256, loss_chars, loss_sha256 of (role, text) in order."""
    whole = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    return (
        len(turns), hashlib.sha256(whole.encode()).hexdigest(),
        len(loss), hashlib.sha256(loss.encode()).hexdigest(),
    )
