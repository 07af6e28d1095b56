"""Brute-force models that several tests share."""

from test_dedup import brute_components, slow_fingerprint


def brute_components_of(texts):
    """The ids that stay when one of each group of near-duplicates does."""
    ids = sorted(texts, key=lambda i: (i is None, i or 0))
    fp = [slow_fingerprint(texts[i]) for i in ids]
    rank = brute_components(fp, list(range(len(ids))))
    return [ids[r] for r in sorted(set(rank))]
