from itertools import product

from pairloom.llm.related import closest_totals


def total(took):
    return sum(s * n for s, n in took.items())


def test_large_totals_are_exact():
    sizes = {3_000_001: 7, 1_000_003: 9, 17: 40, 1: 5}
    reach = {sum(s * k for s, k in zip(sizes, ks)) for ks in product(*(range(n + 1) for n in sizes.values()))}
    for share in (0.05, 0.3, 0.47):
        want = round(share * total(sizes))
        took = closest_totals(sizes, [1 - share, share])[0]
        assert all(n <= sizes[s] for s, n in took.items())
        assert abs(total(took) - want) == min(abs(r - want) for r in reach)


def test_many_sizes_hit_their_shares():
    sizes = {s: 101 for s in range(3, 700)} | {1: 1000}
    for took in closest_totals(sizes, [0.9, 0.05, 0.05]):
        assert total(took) == round(0.05 * total(sizes))


def test_a_billion_records_are_hit_in_little_memory():
    for sizes in ({1: 600_000_000, 7: 40_000_000, 1000: 100_000}, {3: 200_000_000, 50_021: 7_000}, {2: 10**8, 3: 10**8, 10**8: 4}):
        for took in closest_totals(sizes, [0.9, 0.05, 0.05]):
            assert total(took) == round(0.05 * total(sizes))
