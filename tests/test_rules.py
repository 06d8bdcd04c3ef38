"""Ordered rules as a table, and addresses by their parts, against plain loops and lists of cases."""

import random

import pytest
from pyspark.sql import functions as F

from quillon.functions.links import safe_url
from quillon.operators import rules


def brute(host, table):
    if host is None:
        return None
    labels = host.lower().split(".")
    best = None
    for position, suffix, here, below, value in table:
        for cut in range(len(labels)):
            if ".".join(labels[cut:]) == suffix.lower() and (here if cut == 0 else below):
                best = min(best or (position, value), (position, value))
    return best and best[1]


@pytest.mark.parametrize("most", [100_000, 1])
def test_the_first_rule_of_each_host(spark, monkeypatch, most):
    monkeypatch.setattr(rules, "MOST_BROADCAST", most)  # beyond it rules meet by an exchange
    rng = random.Random(most)
    label = lambda: rng.choice(["a", "b", "c", "Shop", "org"])
    name = lambda n: ".".join(label() for _ in range(rng.randint(1, n)))
    table = [(rng.randrange(20), name(3), rng.random() < 0.6, rng.random() < 0.6, f"v{n}") for n in range(40)]
    hosts = [name(5) for _ in range(200)] + ["", None, "a", "a"]
    found = rules.first_rule(spark.createDataFrame(list(enumerate(hosts)), "id int, host string"), spark.createDataFrame(table, rules.RULES))
    assert {r["id"]: r["value"] for r in found.collect()} == {i: brute(h, table) for i, h in enumerate(hosts)}
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    assert rules.first_rule(spark.createDataFrame([], "id int, host string"), spark.createDataFrame(table, rules.RULES)).count() == 0


SAFE = [
    "https://x.org", "HTTP:x.org", "https:\\\\x.org\\p", "http://u:p@q@x.org:80/", "http://x.org:", "http://[::1]:8080/", "http://[1:2:3:4:5:6:7:8]", "http://0x7f.0.0.1", "http://1", "http://017700000001", "http://1.2.3.4.", "http://a_b.org", "http://x.org:65535",
    "mailto:", "tel:+1", "www.x.org", "www.", "WWW.x.org/p", " ht\ntps://x.org ", "http://ex%61mple.org", "http://a+b.org", "http://ü.org", "http://x.org?q=<>|", "http://[::ffff:1.2.3.4]",
]
UNSAFE = [
    "", " ", "x.org", "/p", "//x.org", "javascript:x", "data:text/html,x", "ftp://x.org", "https://", "https:///", "https://?q", "http://u@/", "http://a b^c.org", "http://x|y.org", "http://x.org:65536", "http://x.org:8a", "http://256.1.1.1", "http://1.2.3.4.5", "http://08.1", "http://foo.1", "http://4294967296",
    "http://[::1", "http://[1:2:3]", "http://[1::2::3]", "http://[12345::]", "http://[::1.2.3.400]", "http://a%zz.org", "http://a%2Fb.org", "http://a%00.org", "http://<x>.org",
]


def test_addresses_that_are_safe(spark):
    rows = spark.createDataFrame([(u,) for u in [*SAFE, *UNSAFE, None]], "u string").select("u", safe_url("u").alias("s")).collect()
    found = {r["u"]: r["s"] for r in rows}
    assert [u for u in SAFE if found[u] is None] == []
    assert [u for u in UNSAFE if found[u] is not None] == [] and found[None] is None
    assert found[" ht\ntps://x.org "] == "https://x.org" and found["WWW.x.org/p"] == "https://WWW.x.org/p"
    assert spark.createDataFrame([("x",)], "u string").select(F.isnull(safe_url("u"))).first()[0]
