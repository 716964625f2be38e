"""J10 over networks of both families against Python's ``ipaddress``."""
import ipaddress
import random

import pytest

from alertspark.operators.prefixes import prefix_join


def _net(text):
    try:
        return ipaddress.ip_network(text, strict=False)
    except ValueError:
        return None


def _texts(seed, n):
    r = random.Random(seed)
    out = ["0.0.0.0/0", "::/0", "10.0.0.0/8", "10.1.2.3/32", "10.1.2.3", "fc00::/7", "ffff::/16", "::ffff:10.1.2.3/104", "8000::/1", "128.0.0.0/1"]
    for _ in range(n):
        if r.random() < 0.5:
            a = f"{r.choice((10, 11, 172, 255))}.{r.choice((0, 1, 255))}.{r.randrange(4)}.{r.randrange(256)}"
            out.append(a + r.choice(("", f"/{r.randrange(33)}")))
        else:
            v = (r.choice((0xFC00, 0xFFFF, 0x2002, 0)) << 112) | (r.randrange(3) << 64) | (r.randrange(2) << 63) | r.randrange(5)
            out.append(str(ipaddress.IPv6Address(v)) + r.choice(("", f"/{r.randrange(129)}")))
    return out


@pytest.mark.parametrize("max_bytes", [64 << 20, 0])
def test_networks_in_networks_of_both_families(spark, max_bytes):
    left, right = _texts(1, 120), _texts(2, 90)
    bad = [None, "", "x", "10.0.0.0/33", "::/129", "10.0.0.0/", "10.0.0.0/08", "10.0.0.0/255.0.0.0", "01.2.3.4", "1.2.3", "10.0.0.0/8/8", ":::/3"]
    a = spark.createDataFrame([(i, x) for i, x in enumerate(left + bad)], "i int, x string")
    b = spark.createDataFrame([(j, x) for j, x in enumerate(right + bad)], "j int, network string")
    got = sorted((r.i, r.j) for r in prefix_join(a, "x", b, max_bytes=max_bytes).collect())
    want = sorted((i, j) for i, x in enumerate(left) for j, y in enumerate(right)
                  if _net(x).version == _net(y).version and _net(x).subnet_of(_net(y)))
    assert got == want and len(want) > 200


def test_repeated_rows_and_empty_sides(spark):
    a = spark.createDataFrame([("10.0.0.1",), ("10.0.0.1",)], "x string")
    b = spark.createDataFrame([("10.0.0.0/8",), ("10.9.9.9/8",)], "network string")
    assert prefix_join(a, "x", b).count() == 4
    assert prefix_join(a, "x", b.limit(0)).count() == 0
    assert prefix_join(a.limit(0), "x", b).columns == ["x", "network"]


def test_no_nested_loop(spark):
    a = spark.createDataFrame([("10.0.0.1",)], "x string")
    plan = prefix_join(a, "x", a.withColumnRenamed("x", "network"))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
