"""Plain sequential forms of the order-dependent rules, used only to check the Spark jobs."""

from itertools import combinations


def greedy(leds, banks, options):
    """leds/banks: dicts with idx, day, cents, direction -> {led idx: (bank idx, same direction)}"""
    taken, used = {}, set()
    for same in (True, False):
        pairs = []
        open_banks = [b for b in banks if b["idx"] not in used]
        for led in leds:
            if led["idx"] in taken:
                continue
            pool = [b for b in open_banks
                    if b["day"] is not None and abs(b["day"] - led["day"]) <= options.tolerance_days]
            exact = [b for b in pool if b["cents"] is not None and b["cents"] == led["cents"]]
            for b in exact or pool:
                if (b["direction"] == led["direction"]) != same:
                    continue
                score = options.pair_score(led["cents"] is not None and b["cents"] == led["cents"], abs(b["day"] - led["day"]), same)
                pairs.append((-score, led["idx"], b["idx"]))
        for negative, led, bank in sorted(pairs):
            if led in taken or bank in used or -negative < options.min_score:
                continue
            taken[led] = (bank, same)
            used.add(bank)
    return taken


def settle_by_sum(targets, pool, options):
    """One pass of target rows, in index order, consuming pool rows that sum to them exactly."""
    free = {p["idx"]: p for p in pool}
    found = {}
    for t in sorted(targets, key=lambda r: r["idx"]):
        near = sorted(i for i, p in free.items()
                      if p["direction"] == t["direction"] and abs(p["day"] - t["day"]) <= options.tolerance_days)
        if not near or len(near) > options.max_pool:
            continue
        sizes = range(2, min(options.max_combination, 3) + 1) if options.max_combination >= 2 else [2]
        hit = next((c for n in sizes for c in combinations(near, n)
                    if sum(free[i]["cents"] for i in c) == t["cents"]), None)
        if hit:
            found[t["idx"]] = hit
            for i in hit:
                del free[i]
    return found
