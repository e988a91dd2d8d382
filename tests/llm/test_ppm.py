import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from clonespark.llm import ppm


def brute_trie(words, texts, order):
    seen = defaultdict(Counter)
    for w, n in [*words.items()]:
        line = b" " + w.encode() + b" "
        for p in range(1, len(line)):
            for k in range(min(p, order) + 1):
                seen[line[p - k : p]][line[p]] += n
    if texts:
        seen[b""][ppm.END] += texts
        seen[b" "][ppm.END] += texts
    return seen


def brute_log10(seen, context, symbol, order):
    context = context[max(0, len(context) - order) :]
    p, ruled_out = 1.0, set()
    while True:
        follow = seen.get(context)
        if follow:
            left = {s: n for s, n in follow.items() if s not in ruled_out}
            if left:
                total = sum(left.values()) + len(left)
                if symbol in left:
                    return math.log10(p * left[symbol] / total)
                p *= len(left) / total
                ruled_out |= set(follow)
        if not context:
            return math.log10(p / max(1, 256 - len(seen.get(b"", ()))))
        context = context[1:]


def test_trie_is_ppm_with_exclusion():
    rng = random.Random(4)
    words = Counter("".join(rng.choice("abcdé\0") for _ in range(rng.randint(1, 9))) for _ in range(400))
    seen = brute_trie(words, 7, ppm.ORDER)
    node, n = [], []
    table = pa.array(list(words))
    stream, depth, first = ppm.symbols(table)
    weight = np.repeat(list(words.values()), np.diff(first))
    for k in range(ppm.ORDER + 1):
        deep = depth >= k
        key, at = np.unique(ppm.keys(stream, k)[deep], return_inverse=True)
        node.append(key)
        n.append(np.bincount(at, weight[deep]))
    node += [np.array([ppm.END, 1 << 56 | ppm.SPACE << 8 | ppm.END], np.uint64)]
    n += [np.array([7, 7])]
    trie = ppm.Trie(np.concatenate(node), np.concatenate(n))
    probes = ["abc", "zzz", "é", "abcdabcdabcd", "x", *list(words)[:40]]
    for w, got in zip(probes, trie.words_log10(pa.array(probes)), strict=True):
        line = b" " + w.encode() + b" "
        want = sum(brute_log10(seen, line[:p], line[p], ppm.ORDER) for p in range(1, len(line)))
        assert abs(got - want) < 1e-9, w
    assert abs(trie.end_log10() - brute_log10(seen, b" ", ppm.END, ppm.ORDER)) < 1e-12
    # After any context the bytes' probabilities add up to one.
    for context in (b" ab", b" q"):
        total = sum(10 ** trie.bytes_log10(np.frombuffer(context + bytes([s]), np.uint8), np.arange(1, len(context) + 1))[-1] for s in range(256))
        assert abs(total - 1) < 1e-9


def test_no_training_is_uniform():
    trie = ppm.Trie(np.zeros(0, np.uint64), np.zeros(0))
    assert abs(trie.words_log10(pa.array(["ab"]))[0] + 3 * math.log10(256)) < 1e-12
