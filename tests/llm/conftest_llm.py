"""Brute-force versions that several tests use."""

import math
import re
from collections import Counter

import numpy as np
import xxhash

from lectern.llm import decontamination as d
from lectern.llm import quality_rules as q


def brute_components(prints: dict[int, int], radius: int = 3) -> dict[int, int]:
    """Smallest id reachable over links of at most ``radius`` differing bits: all pairs."""
    name = {k: k for k in prints}
    changed = True
    while changed:
        changed = False
        for a, x in prints.items():
            for b, y in prints.items():
                if (x ^ y).bit_count() <= radius and name[b] < name[a]:
                    name[a], changed = name[b], True
    return name


def plain_simhash(text):
    """Bit by bit, shingle by shingle."""
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_statistics(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(w, w[1:], w[2:]))
    repeated = {k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), again, len(repeated)


def rowwise_mcd(x):
    """The textbook estimate from the rows themselves: many random starts, concentration steps, the least determinant."""
    rng, floor = np.random.default_rng(2), np.diag(np.square(q.FLOOR))
    h, best = int(np.ceil(q.SHARE * len(x))), None
    for _ in range(60):
        part = x[rng.choice(len(x), min(len(x), 2 * q.P), replace=False)]
        for _ in range(40):
            mean, cov = part.mean(0), np.cov(part.T, bias=True) + floor
            d = ((x - mean) @ np.linalg.inv(cov) * (x - mean)).sum(1)
            part = x[np.argsort(d, kind="stable")[:h]]
        mean, cov = part.mean(0), np.cov(part.T, bias=True) + floor
        if best is None or np.linalg.det(cov) < np.linalg.det(best[1]):
            best = mean, cov
    point, cdf = q.chi2_quantile(q.SHARE, q.P), lambda v: 1 - math.exp(-v / 2) * (1 + v / 2 + v * v / 8)  # of P + 2 = 6 degrees
    return best[0], q.SHARE / cdf(point) * (best[1] - floor) + floor


def plain_distances(rows):
    """doc_id → squared distance of each row (doc_id, text, lang, source) that passes the base rule: all statistics by a plain
    count, estimates row by row."""
    stats = {r.doc_id: plain_statistics(r.text) for r in rows}
    rows = [r for r in rows if stats[r.doc_id][0] >= 50 and 2 * stats[r.doc_id][4] <= stats[r.doc_id][0]]
    x = np.array([[c / w, np.log1p(100 * s / w), np.log1p(100 * t / w), p / w] for w, c, s, t, p in (stats[r.doc_id] for r in rows)])
    x = np.minimum(x, q.TOP)
    drawn = lambda n, own, wide: tuple((n * a + q.PRIOR * b) / (n + q.PRIOR) for a, b in zip(own, wide))
    whole, langs, out = rowwise_mcd(x), {}, {}
    for lang in {r.lang for r in rows}:
        mine = np.array([r.lang == lang for r in rows])
        langs[lang] = drawn(mine.sum(), rowwise_mcd(x[mine]), whole)
    for lang, source in {(r.lang, r.source) for r in rows}:
        mine = np.array([(r.lang, r.source) == (lang, source) for r in rows])
        mean, cov = drawn(mine.sum(), rowwise_mcd(x[mine]), langs[lang])
        for k in np.flatnonzero(mine):
            out[rows[k].doc_id] = float((x[k] - mean) @ np.linalg.inv(cov) @ (x[k] - mean))
    return out


def plain_tokens(words: list[str], small: set[str], reading: int) -> list[tuple[str, str]]:
    """(token, filler) of each token, by the definitions, one word after the other."""
    out, closed = [], True
    for w in words:
        c = w.strip(d.MARKS)
        if not c:
            continue
        low = c.casefold()
        number, name = c[0].isdigit(), (c[0].isupper() if reading == 0 else low not in small)
        before, was_closed = out[-1][0] if out else None, closed
        closed = w[-1] != c[-1]
        if reading == 1:
            out.append(("w " + low, low))
        elif number:
            out.append(("<num>", low))
        elif before == "<num>" and low in d.UNITS and not (reading == 0 and name):
            out.append(("<unit>", low))
        elif name:
            if before == "<name>" and not was_closed:
                out[-1] = ("<name>", low)
            else:
                out.append(("<name>", low))
        else:
            out.append(("w " + low, low))
    return out


def plain_match(text: str, item: str, small: set[str]) -> bool:
    """All pairs of equal windows, all bands of diagonals, all tokens: no hashes, no joins."""
    for reading in range(3):
        mine, its = plain_tokens(text.split(), small, reading), plain_tokens(item.split(), small, reading)
        size = min(d.WINDOW, len(its)) if reading == 1 else d.WINDOW
        tells = lambda x: sum(t[:2] == "w " for t, _ in x) >= min(size, d.LITERALS)
        places = [q for q in range(len(its) - size + 1) if tells(its[q : q + size])]
        if not size or not places:
            continue
        key = lambda x: tuple(t for t, _ in x)
        at = {}
        for p in range(len(mine) - size + 1):
            at.setdefault(key(mine[p : p + size]), []).append(p)
        pairs = [(p, q) for q in places for p in at.get(key(its[q : q + size]), ())]
        need = min(d.CONTAINED * len(places), d.RUN_WORDS - d.WINDOW + 1)
        for c in {(p - q) // d.DRIFT for p, q in pairs}:
            near = [(p, q) for p, q in pairs if (p - q) // d.DRIFT in (c, c + 1)]
            count = len({q for _, q in near})
            if count < need:
                continue
            tokens = {(p + k, q + k) for p, q in near for k in range(size)}
            stands: dict = {}
            for a, b in tokens:
                if its[b][0][0] == "<":
                    stands.setdefault(its[b], []).append(mine[a][1])
            again = [x for x in stands.values() if len(x) > 1]
            consistency = sum(max(map(x.count, x)) for x in again) / sum(map(len, again)) if again else 1.0
            same = {(a, b) for a, b in tokens if its[b][0][0] != "<" or mine[a][1] == its[b][1]}
            run = 0
            for a, b in same:
                n = 0
                while (a + n, b + n) in same:
                    n += 1
                run = max(run, n)
            if count >= d.CONTAINED * len(places) and consistency >= d.CONSISTENT or run >= d.RUN_WORDS:
                return True
    return False
