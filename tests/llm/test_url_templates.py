"""Back-off and generalisation of the url templates against a plain version."""

import random
from collections import defaultdict

from docrevise.llm import url_filter
from tests.llm import brute

DDL = "host string, path string, blocked boolean"


def verdicts(templates, z=1.96, min_labels=5, s=2.0, purity=0.8):
    """{(host, template): reject} from [(host, raw, template, blocked or None)], one node at a time."""
    count, units = defaultdict(lambda: [0, 0]), defaultdict(lambda: defaultdict(list))
    for host, raw, t, blocked in templates:
        for i in range(len(t) + 2):
            if blocked is not None:
                c = count[host, (*t, "")[:i]]
                c[0], c[1] = c[0] + 1, c[1] + blocked
                units[host, (*t, "")[:i]][(*raw, "")[:i]].append(blocked)
    kids = defaultdict(list)
    for host, v in count:
        if v:
            kids[host, v[:-1]].append(v)

    def branch(host, v):
        if not v:
            return count[host, v], len(units[host, v])
        by = defaultdict(list)
        for x in kids[host, v[:-1]]:
            n, b = count[host, x]
            by[b / n].append(x)
        groups, before = [], None
        for p in sorted(by):
            n, b = (sum(count[host, x][i] for x in by[p]) for i in (0, 1))
            if before:
                q = (b + before[1]) / (n + before[0])
                far = p - before[1] / before[0] > z * (q * (1 - q) * (1 / n + 1 / before[0])) ** 0.5
            if not before or far:
                groups.append([])
            groups[-1] += by[p]
            before = n, b
        mine = next(g for g in groups if v in g)
        return [sum(count[host, x][i] for x in mine) for i in (0, 1)], sum(len(units[host, x]) for x in mine)

    hosts = {host for host, v in count if not v}
    prior = sum(count[h, ()][1] for h in hosts) / max(1, sum(count[h, ()][0] for h in hosts))
    out = {}
    for host, t in {(x[0], x[2]) for x in templates}:
        share, evidence, chain = prior, 0, (*t, "")
        for i in range(len(chain) + 1):
            v = chain[:i]
            siblings = [u for x in kids[host, v[:-1]] for u in units[host, x].values()] if v else []
            if (host, v) not in count:
                if v and (host, v[:-1]) in count:
                    share = (sum(sum(u) / len(u) for u in siblings) + s * share) / (len(siblings) + s)
                    evidence += len(siblings)
                break
            (n, b), size = branch(host, v)
            share = (b + s * share) / (n + s)
            evidence += n + len(siblings) - size if i == len(chain) else len(siblings) - len(units[host, v]) if v else 0
        out[host, t] = evidence >= min_labels and share >= purity
    return out


def test_unlabelled_templates_back_off(spark):
    """Urls without labels of their own are decided by their siblings' labels."""
    rows = [("h.org", f"/{x}/p/{i}", True) for x in "abcdef" for i in range(3)] + [("h.org", "/new/p/1", None), ("h.org", "/new", None)]
    rows += [("two.org", f"/{x}/p", True) for x in "ab" for _ in range(50)] + [("two.org", "/new/p", None), ("none.org", "/a/p/1", None), ("ok.org", "/a", False)]
    t = {(r["host"], "/".join(r["raw"])): r["reject"] for r in url_filter.learn_templates(spark.createDataFrame(rows, DDL)).collect()}
    assert t["h.org", "new/p/*"] and t["h.org", "new"] and t["h.org", "a/p/*"]
    assert not t["two.org", "new/p"] and t["two.org", "a/p"] and not t["none.org", "a/p/*"] and not t["ok.org", "a"]


def test_labels_table_decides_unseen_urls(spark):
    labels = spark.createDataFrame([("h.org", f"/{x}/p", True) for x in "abcdef"] + [("ok.org", "/a", False)], DDL)
    pages = spark.createDataFrame([(1, "http://h.org/new/p"), (2, "http://ok.org/b"), (3, "http://h.org/a/p")], "page_id bigint, url string")
    assert {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(pages, rules=(), labels=labels).collect()} == {1: "block", 2: "allow", 3: "block"}


def test_shares_against_brute(spark):
    r = random.Random(7)
    for _ in range(3):
        rows = []
        for _ in range(1500):
            host, path = f"h{r.randrange(12)}.org", [f"{'abcdefgh'[r.randrange(8)]}" for _ in range(r.randrange(4))]
            bad = 0.95 if path and path[0] in "abcde" else 0.1
            rows.append((host, "/" + "/".join(path), r.random() < bad if r.random() < 0.15 else None))
        got = url_filter.learn_templates(spark.createDataFrame(rows, DDL)).collect()
        template = {(x["host"], tuple(x["raw"])): tuple(x["template"]) for x in got}
        want = verdicts([(h, raw := tuple(x for x in p.split("/") if x), template[h, raw], b) for h, p, b in rows])
        assert {(x["host"], tuple(x["template"])): x["reject"] for x in got} == want
        unlabelled = [x for x in got if x["n_labels"] == 0]
        assert 0 < sum(x["reject"] for x in unlabelled) < len(unlabelled)


def test_query_verdicts_against_brute(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    rows = []
    for p, url in pages.collect():
        host, path = brute.url_parts(url)
        _, ruled = brute.url_rule(host, path)
        rows.append((p, host, path, ruled))
    parsed = spark.createDataFrame([(h, p, None if v is None else v == "block") for _, h, p, v in rows], DDL)
    raw = [tuple(r[0]) for r in parsed.select(url_filter.segments(parsed["path"])).collect()]
    want = verdicts([(h, t, t, None if v is None else v == "block") for (_, h, _, v), t in zip(rows, raw)])
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(pages).collect()}
    assert got == {p: v or ("block" if want[h, t] else "allow") for (p, h, _, v), t in zip(rows, raw)}


def test_number_of_segments_changes_no_verdict(spark):
    """Clean sections beside rule-labelled ones, and a variable segment with
    bad and good pages below it: equal verdicts for any number of children."""
    rows = []
    for k in (29, 31, 1000):
        rows += [(f"net{k}", f"/{x}/{i}", True) for x in ("es", "fr") for i in range(20)] + [(f"net{k}", f"/s{chr(97 + i % 26)}{i}x/1", None) for i in range(k - 2)]
        for i in range(k):
            x = f"/u{i}x"
            rows += [(f"two{k}", f"{x}/buy", True if i % 3 else None), (f"two{k}", f"{x}/info", False if i % 3 else None), (f"mix{k}", f"{x}/p", i % 2 == 0), (f"mix{k}", f"{x}/p", i % 2 == 0)]
        rows.append((f"mix{k}", "/new/p", None))
    t = url_filter.learn_templates(spark.createDataFrame(rows, DDL)).collect()
    for k in (29, 31, 1000):
        mine = {kind: [r for r in t if r["host"] == f"{kind}{k}"] for kind in ("net", "two", "mix")}
        assert [r["reject"] for r in mine["net"]].count(True) == 2 and {r["raw"][0] for r in mine["net"] if r["reject"]} == {"es", "fr"}
        assert len(mine["two"]) == 2 * k and all(r["reject"] == (r["raw"][1] == "buy") for r in mine["two"])
        assert not any(r["reject"] for r in mine["mix"] if r["raw"][0] == "new") and all(r["template"] == r["raw"] for r in mine["mix"])
