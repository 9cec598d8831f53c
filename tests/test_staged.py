"""Discovery in stages against a plain loop over companies."""

import random

from sparkfolio.operators import corpus as C

KIND = "company string, seq int, discovery string, url string, title string, description string, asked int"


def loop(results, companies, years):
    """What the stages come to see, asked one after another."""

    def hit(r):
        for text in (r[4], r[3], r[5]):
            found = [int(t) for t in (text or "").replace("/", " ").replace(".", " ").split() if t.isdigit() and len(t) == 4]
            if found:
                year = max(found)
                said = " ".join(x or "" for x in (r[3], r[4], r[5])).lower()
                return year if year in years and "annual report" in said and "interim" not in said else None
        return None

    seen = {}
    for company, domain in companies:
        mine = [r for r in results if r[0] == company]
        pool = [r for r in mine if r[2] == "map"] if domain else []
        found = lambda: {hit(r) for r in pool} - {None}  # noqa: B023, E731
        if domain and found() != set(years):
            pool += [r for r in mine if r[2] == "page"]
        if found() != set(years):
            pool += [r for r in mine if r[2] == "search"]
        still = found()
        pool += [r for r in mine if r[2] == "deep_search" and r[6] in years and r[6] not in still]
        stages = {y: min(C.STAGES.index(r[2]) for r in pool if hit(r) == y) for y in found()}
        seen |= {r[1]: hit(r) if hit(r) and stages[hit(r)] == C.STAGES.index(r[2]) else None for r in pool}
    return seen


def test_equals_the_loop(spark):
    r = random.Random(5)
    years = [2020, 2021, 2022]
    companies = [(f"c{k}", r.choice(["", "a.example"])) for k in range(25)]
    say = lambda: r.choice(["Annual Report 2020", "annual report 2021", "Annual Report 2022", "Annual Report 2022 interim", "2019 Annual Report", "news", None])
    results = [(f"c{r.randrange(26)}", k, r.choice([*C.STAGES, "other"]), "https://x.example/f", say(), r.choice([None, "of 2020", "text"]), r.choice([2020, 2021, 2022, 2030, None])) for k in range(400)]
    frame = spark.createDataFrame(results, KIND)
    told = C.staged(frame, spark.createDataFrame(companies, "company string, domain string"), years)
    assert {x.seq: x.supplied for x in told.collect()} == loop(results, companies, years)
    best = C.discover(frame.drop("asked"), spark.createDataFrame(companies, "company string, domain string"), years, stages=C.STAGES[:1])
    assert {x.discovery for x in best.collect()} == {"map"}
