"""The label model against plain loops: votes word by word, expectation maximisation pattern by pattern."""

import math
import re
from collections import Counter

from railside.llm.quality import FUNCTION_WORDS, LABELLERS, quality_scores
from tests.oracle import SMALL

MARKS = set(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def _statistics(text: str | None) -> dict[str, float]:
    raw = (text or "").encode()
    words = [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", raw)]
    lines = [x.lower() for x in raw.split(b"\n") if x]
    n, m, size = max(1, len(words)), max(1, len(lines)), max(1, len(raw))
    share = lambda chars: sum(b in set(chars) for b in raw) / size
    return {
        "words": len(words), "lines": len(lines), "symbols": share(b"#$%&*|{}<>^~=\\_"), "marks": share(MARKS), "shouts": share(b"!?"), "capitals": share(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "ends": raw.count(b".") / n,
        "bare": sum(not any(b > 32 and b not in MARKS for b in w) for w in words) / n, "variety": len(set(words)) / n, "line variety": len(set(lines)) / m,
        "neighbours": sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, "function words": len(set(words) & {w.encode() for w in FUNCTION_WORDS}),
    }


def _votes(text: str | None) -> tuple[int, ...]:
    s, out = _statistics(text), []
    for name, bad, good, unit, least in LABELLERS.values():
        above = bad > good
        reject = s[name] > bad if above else s[name] < bad
        keep = s[name] < good if above else s[name] > good
        out.append(2 if s[unit] < least else 0 if reject else 1 if keep else 2)
    return tuple(out)


def _posteriors(counts: Counter) -> dict[tuple[int, ...], float]:
    good = {p: 0.1 if 0 in p else 0.95 if 1 in p else 0.8 for p in counts}
    for _ in range(100):
        total = sum(counts.values())
        prior = (sum(counts[p] * good[p] for p in counts) + 1) / (total + 2)
        odds = {}
        for c, pseudo in ((0, (1.0, 1.0)), (1, (0.1, 1.9))):
            weight = {p: counts[p] * (good[p] if c else 1 - good[p]) for p in counts}
            for k in range(len(LABELLERS)):
                votes = [pseudo[v] + sum(w for p, w in weight.items() if p[k] == v) for v in (0, 1)]
                for v in (0, 1):
                    odds[c, k, v] = votes[v] / sum(votes)
        new = {}
        for p in counts:
            log = [math.log(x) + sum(math.log(odds[c, k, v]) for k, v in enumerate(p) if v < 2) for c, x in ((0, 1 - prior), (1, prior))]
            new[p] = 1 / (1 + math.exp(log[0] - log[1]))
        done, good = max(abs(new[p] - good[p]) for p in counts) < 1e-9, new
        if done:
            break
    return good


def test_posteriors_by_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    votes = {r.doc_id: _votes(r.text) for r in docs.collect()}
    posterior = _posteriors(Counter(votes.values()))
    rows = quality_scores(docs).collect()
    assert len(rows) == len(votes) and all(abs(r.posterior - posterior[votes[r.doc_id]]) < 1e-6 for r in rows)
    # the scorer follows the labels that it was given, and decides by its own score
    sure = [r for r in rows if not 0.2 <= r.posterior <= 0.8]
    assert sum((r.score >= 0.5) == (r.posterior >= 0.5) for r in sure) >= 0.98 * len(sure) and all(r.kept == (r.score >= 0.5) for r in rows)
