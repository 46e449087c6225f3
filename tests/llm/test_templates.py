"""Path templates and their verdicts against a plain walk down the tree."""

import math
import random
from collections import defaultdict

from tidewatch.llm import urlfilter

RULES = [("allow", "a.com/ok/"), ("block", "a.com/x/1/2/3/4/bad/"), ("allow", "a.com/x/1/2/3/4/good/"), ("block", "b.org/")]


def plain(urls):
    """url -> template, walking one level at a time."""
    rows = []
    for host, path in urls:
        fits = [(len(r), v) for v, r in RULES if host == r.split("/", 1)[0] and path.startswith("/" + r.split("/", 1)[1])]
        label = None if not fits else int(max(fits)[1] == "block")
        rows.append([host, [s for s in path.split("/") if s], label, ""])
    for level in range(max(len(r[1]) for r in rows)):
        nodes = defaultdict(list)
        for r in rows:
            if len(r[1]) > level:
                nodes[r[0], r[3]].append(r)
        for members in nodes.values():
            branches = defaultdict(list)
            for r in members:
                branches[r[1][level]].append(r)
            labels = [r[2] for r in members if r[2] is not None]
            for segment, branch in branches.items():
                mine = [r[2] for r in branch if r[2] is not None]
                others = len(labels) - len(mine)
                differs = False
                if mine and others:
                    p = sum(labels) / len(labels)
                    spread = math.sqrt(p * (1 - p) * (1 / len(mine) + 1 / others))
                    differs = abs(sum(mine) / len(mine) - (sum(labels) - sum(mine)) / others) > urlfilter.Z * spread
                keep = len(branch) >= urlfilter.SUPPORT and len(branch) >= urlfilter.SHARE * len(members) and (len(branch) == len(members) or differs)
                for r in branch:
                    r[3] += "/" + (segment if keep else "*")
    return rows


def test_templates_equal_a_plain_walk_at_any_depth(spark):
    rng = random.Random(3)
    urls = [("a.com", f"/x/1/2/3/4/{k}/{i % 7}/z") for k in ("bad", "good", "new") for i in range(30)]
    urls += [("a.com", "/" + "/".join(rng.choice("pqr") for _ in range(rng.randrange(9)))) for _ in range(120)]
    urls += [("b.org", f"/{i}") for i in range(12)] + [("c.net", "/deep" * 40)] * 3 + [("c.net", "//a//b/")] * 11 + [("a.com", "/ok/x")] * 15
    pages = spark.createDataFrame([(i, f"http://{h}{p}") for i, (h, p) in enumerate(urls)], "page_id long, url string")
    got = {r.page_id: r for r in urlfilter.judged(pages, RULES).collect()}
    want = plain(urls)
    assert [got[i].template for i in range(len(urls))] == [r[3] for r in want]
    kinds = {k: {(got[i].template, got[i].verdict) for i, (_, p) in enumerate(urls) if f"/4/{k}/" in p} for k in ("bad", "good", "new")}
    assert {t.split("/")[6] for t, _ in kinds["bad"]} == {"bad"} and {v for _, v in kinds["bad"]} == {"block"}
    assert {v for _, v in kinds["good"]} == {"allow"}
    # purity: smoothed towards the host's, and that towards the share over all
    labelled = [r[2] for r in want if r[2] is not None]
    overall, w = sum(labelled) / len(labelled), urlfilter.WEIGHT
    for i, r in enumerate(want):
        host = [x[2] for x in want if x[0] == r[0] and x[2] is not None]
        mine = [x[2] for x in want if (x[0], x[3]) == (r[0], r[3]) and x[2] is not None]
        above = (sum(host) + w * overall) / (len(host) + w)
        purity = (sum(mine) + w * above) / (len(mine) + w)
        assert abs(got[i].purity - purity) < 1e-12
        if got[i].rule is None:
            assert got[i].verdict == ("block" if purity >= urlfilter.REJECT else "allow")
