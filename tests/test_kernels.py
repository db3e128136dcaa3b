import random

import numpy as np
import pytest

from seqloom.functions import alignment as al
from seqloom.functions import masking
from seqloom.functions import statistics as st
from seqloom.functions.alphabet import BLOSUM62, DNA

MATCH = np.full((5, 5), -1)
np.fill_diagonal(MATCH, 2)
# Sequences and their masked forms.
MASKS = {
    "SESEWWAKKPILQNFMKGAYCPLND": None,
    "ARASGGQKNLYCKIL*KVLIVL*M": None,
    "RERVVGKKTYTAKFYERCLLSSE*": None,
    "IIQRTISTFHKILQYRFFCPPLALA": None,
    "SFRGQ*APFIKFCSIGFFAHHSLS": None,
    "HSEDNKHLS*NFAV*VFLPTTRSR": None,
    "A" * 25: "x" * 25,
    "S" * 25: "x" * 25,
    "L" * 24: "x" * 24,
    "C" * 24: "x" * 24,
    "Q" * 24: "x" * 24,
    "AAAAAAAAAAAAAAAMKGAYCPLND": "xxxxxxxxxxxAAAAMKGAYCPLND",
    "LLLLLLLLLLLLLLL*KVLIVL*M": "xxxxxxxxxxxxxxxxKxxxxxxx",
    "CCCCCCCCCCCCCCYERCLLSSE*": "xxxxxxxxxxxxxxYERCLLSSE*",
    "IIQRTISTFHSSSSSSSSSSSSSSS": "IIQRTISTFHxxxxxxxxxxxxxxx",
    "SFRGQ*APFIAAAAAAAAAAAAAA": "SFRGQ*APFIxxxxxxxxxxxxxx",
    "HSEDNKHLS*QQQQQQQQQQQQQQ": "HSEDNKHLSxxxxxxxxxxxxxxx",
}


@pytest.mark.parametrize(("seq", "expected"), MASKS.items())
def test_seg(seq, expected):
    assert masking.mask(seq) == (expected or seq)


def test_seg_needs_a_window():
    assert masking.mask("A" * 11) is None


def lane(seq, at):
    codes = DNA.encode(seq)
    return al.Lanes(codes, np.array([at]), np.array([0]), np.array([len(codes)]))


@pytest.mark.parametrize(
    ("at", "step", "drop", "score", "length"),
    [(0, 1, 10**9, 9, 6), (5, -1, 10**9, 9, 6), (0, 1, 1, 4, 2)],
)
def test_ungapped(at, step, drop, score, length):
    best, n = al.ungapped_side(lane("AAAAAAC", at), lane("AACAAAG", at), step, MATCH, np.array([drop]))
    assert (best[0], n[0]) == (score, length)


def plain_ungapped(q, s, i, j, step, m, drop):
    run = best = 0
    while 0 <= i < len(q) and 0 <= j < len(s):
        run += int(m[q[i], s[j]])
        if run > 0:
            best, run = best + run, 0
        if run <= -drop:
            break
        i, j = i + step, j + step
    return best


def test_ungapped_batch_equals_plain():
    r = np.random.default_rng(3)
    q, s = r.integers(0, 20, 60), r.integers(0, 20, 80)
    i, j = r.integers(0, 60, 200), r.integers(0, 80, 200)
    lanes = lambda c, at: al.Lanes(c, at, np.zeros(200, int), np.full(200, len(c)))
    got = al.ungapped_score(lanes(q, i), lanes(s, j), BLOSUM62.values, np.full(200, 15))
    want = [plain_ungapped(q, s, a - 1, b - 1, -1, BLOSUM62.values, 15) + plain_ungapped(q, s, a, b, 1, BLOSUM62.values, 15) for a, b in zip(i, j, strict=True)]
    assert got.tolist() == want


def test_gapped_fixed_values():
    e = DNA.encode
    assert al.gapped_side(e("AGTCAC"), e("AGCAG"), MATCH, 0, 1, 10**6, trace=True) == (7, 5, 4, [("S", 2), ("D", 1), ("S", 2)])
    assert al.gapped_side(e("AGCAC"), e("AGCAG"), MATCH, 0, 1, 0)[:3] == (8, 4, 4)
    assert al.gapped_side(e(""), e("A"), MATCH, 0, 1, 5) == (0, 0, 0, [])


def plain_gapped(q, s, m, gap_open, gap_extend):
    never = -(10**9)
    h = np.full((len(s) + 1, len(q) + 1), never)
    e, f = h.copy(), h.copy()
    h[0, 0], best = 0, 0
    for i in range(len(s) + 1):
        for j in range(len(q) + 1):
            if i:
                e[i, j] = max(e[i - 1, j], h[i - 1, j] - gap_open) - gap_extend
            if j:
                f[i, j] = max(f[i, j - 1], h[i, j - 1] - gap_open) - gap_extend
            if i or j:
                h[i, j] = max(h[i - 1, j - 1] + m[s[i - 1], q[j - 1]] if i and j else never, e[i, j], f[i, j])
            best = max(best, h[i, j])
    return best


def test_gapped_without_drop_is_the_full_matrix():
    r = random.Random(1)
    for t in range(150):
        q = np.array([r.randrange(20) for _ in range(r.randint(1, 30))])
        s = np.array([r.randrange(20) for _ in range(r.randint(1, 30))])
        if t % 2:
            s = np.concatenate([q[: len(q) // 2], s[:3], q[len(q) // 2 :]])
        score, nq, ns, script = al.gapped_side(q, s, BLOSUM62.values, 3, 1, 700, trace=True)
        assert score == plain_gapped(q, s, BLOSUM62.values, 3, 1)
        total = i = j = 0
        for op, n in script:
            if op == al.SUBSTITUTION:
                total += sum(int(BLOSUM62.values[s[j + k], q[i + k]]) for k in range(n))
            else:
                total -= 3 + n
            i, j = i + n * (op != al.GAP_IN_QUERY), j + n * (op != al.GAP_IN_SUBJECT)
        assert (total, i, j) == (score, nq, ns)


def test_traced_and_score_only_agree_with_drops():
    r = np.random.default_rng(5)
    for _ in range(100):
        q = r.integers(0, 20, 60)
        s = np.where(r.random(60) < 0.7, q, r.integers(0, 20, 60))
        s = np.delete(s, slice(20, 20 + int(r.integers(0, 4))))
        a = al.gapped_side(q, s, BLOSUM62.values, 11, 1, 26)
        assert a[:3] == al.gapped_side(q, s, BLOSUM62.values, 11, 1, 26, trace=True)[:3]


@pytest.mark.parametrize(("subject", "hits", "kept"), [("AAACAAG", [(0, 0), (2, 2)], 1), ("AACAAAG", [(0, 0), (1, 1)], 1), ("AACAAAG", [(0, 0), (3, 3)], 2)])
def test_chain_filter(subject, hits, kept):
    from seqloom.operators.search import chained

    q, s = DNA.encode("AAAAAAC"), DNA.encode(subject)
    assert chained(q, s, np.array(hits), MATCH, 1).sum() == kept


def test_lanes_do_not_touch_one_another():
    r = np.random.default_rng(8)
    qs = [r.integers(0, 20, int(r.integers(0, 90))).astype(np.uint8) for _ in range(70)]
    ss = [np.insert(np.where(r.random(len(q)) < 0.8, q, r.integers(0, 20, len(q))), len(q) // 2, r.integers(0, 20, 4)).astype(np.uint8) if len(q) else q for q in qs]

    def lanes(rows):
        high = np.cumsum([len(x) for x in rows])
        low = high - [len(x) for x in rows]
        return al.Lanes(np.concatenate(rows), low, low, high)

    for cutoff in (5, 26, 52, 5000):  # 16 bits, 32 bits
        all_ = al.gapped_sides(lanes(qs), lanes(ss), 1, BLOSUM62.values, 11, 1, cutoff, trace=True)
        for i, (q, s) in enumerate(zip(qs, ss, strict=True)):
            assert al.gapped_side(q, s, BLOSUM62.values, 11, 1, cutoff, trace=True) == (all_.score[i], all_.query[i], all_.subject[i], all_.scripts[i])


def test_length_adjustment_is_the_largest_fixed_point():
    p, alpha, beta = st.gapped_parameters()
    r = random.Random(6)
    for _ in range(300):
        m, k = int(10 ** r.uniform(0.5, 3)), int(10 ** r.uniform(0, 4))
        n = int(k * 10 ** r.uniform(0.5, 3))
        holds = [x for x in range(m) if k * x < n and p.k * (m - x) * (n - k * x) >= max(m, n) and alpha / p.lam * np.log(p.k * (m - x) * (n - k * x)) + beta >= x]
        assert st.length_adjustment(m, n, k, p, alpha, beta) == max(holds, default=0)


def test_edit_scripts():
    assert al.runs("SSIIS") == [("S", 2), ("I", 2), ("S", 1)]
    assert al.merge([("S", 2)], [("S", 3), ("D", 1)]) == [("S", 5), ("D", 1)]
    assert al.expand([("S", 2), ("D", 1)]) == "SSD"
    a = al.Alignment(0, 0, 4, 0, 3, [("S", 2), ("D", 1), ("S", 2)])
    assert al.edit_counts(DNA.encode("AGTCA"), DNA.encode("AGCT"), a) == (5, 1, 1, 0)


def test_statistics_fixed_values():
    p, alpha, beta = st.gapped_parameters()
    assert st.length_adjustment(25, 175, 7, p, alpha, beta) == 0
    want = {145: ("2.75455e-15", "60.4622"), 139: ("1.36707e-14", "58.151"), 75: ("3.60591e-07", "33.4982"), 59: ("2.58417e-05", "27.335"), 53: ("0.000128251", "25.0238")}
    for score, (evalue, bits) in want.items():
        assert abs(st.evalue_of(score, 4375, p) / float(evalue) - 1) < 1e-5
        assert f"{st.bits_of(score, p):.6g}" == bits
    assert (st.score_from_bits(15, p), st.score_from_bits(25, p)) == (26, 52)
    ideal = st.ideal_ungapped()
    assert abs(ideal.lam - 0.3176) < 1e-4 and abs(ideal.k - 0.134) < 1e-3 and abs(ideal.h - 0.4012) < 1e-3
    with pytest.raises(ValueError, match="no gapped statistics"):
        st.gapped_parameters("BLOSUM62", 9, 1)
    assert st.search_space(10, 5, 3, 9) >= 1
    assert st.karlin(1, np.array([1.0])) is None
