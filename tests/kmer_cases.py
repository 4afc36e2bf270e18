"""Sequences, brute-force counts and result checks that the k-mer tests share."""

from collections import Counter

SF = "/root/testdata/sf0.001"


def frame(spark, seqs):
    return spark.createDataFrame([(s,) for s in seqs], "seq string")


def rc(kmer):
    return kmer[::-1].translate(str.maketrans("ACGT", "TGCA"))


def brute_kmers(seqs, k):
    """Canonical k-mer counts by plain Python."""
    counts = Counter()
    for seq in seqs:
        for fold in "acgt":
            seq = seq.replace(fold, fold.upper())
        for i in range(len(seq) - k + 1):
            window = seq[i : i + k]
            if set(window) <= set("ACGT"):
                counts[min(window, rc(window))] += 1
    return counts


def brute_histogram(counts, n):
    times = Counter(counts.values())
    return [len(counts)] + [times[i] for i in range(1, n + 1)]


def random_seqs(rng, count, low, high, letters="ACGT"):
    return ["".join(rng.choices(letters, k=rng.randint(low, high))) for _ in range(count)]


def estimates(histogram):
    rows = histogram.collect()
    assert [r["i"] for r in rows] == list(range(len(rows)))
    return [r["est"] for r in rows]
