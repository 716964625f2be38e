"""F1/F2 agree with Python 3.13 ``ipaddress`` (the reference's classifier)."""
import ipaddress
import random

from alertspark.functions.ip import classify_cols, classify_ip, with_direction


def py_class(ip, role):
    if not ip:
        return f"unknown_{role}"
    try:
        a = ipaddress.ip_address(ip)
    except ValueError:
        return f"unknown_{role}"
    if a.is_private:
        return f"Internal {role}"
    if a.is_loopback:
        return f"localhost_{role}"
    if a.is_link_local:
        return f"link_local_{role}"
    return f"External {role}"


def _cases():
    rnd = random.Random(7)
    cases = ["", None, "not-an-ip", "10.0.0.1", "01.2.3.4", "1.2.3.4/24", "256.1.1.1", "127.0.0.1",
             "169.254.1.1", "192.0.0.9", "192.0.0.8", "100.64.0.1", "224.0.0.1", "198.51.100.42",
             "::1", "::ffff:8.8.8.8", "::ffff:10.0.0.1", "fe80::1%eth0", "2001:db8::", "1::2::3",
             " 10.0.0.1", "10.0.0.1 ", "fc00::1", "2001:20::1", "::ffff:192.0.0.9"]
    for _ in range(1500):
        cases.append(str(ipaddress.IPv4Address(rnd.getrandbits(32))))
    for _ in range(1500):
        b = rnd.getrandbits(128)
        if rnd.random() < 0.4:
            b = (rnd.choice([0x2001, 0xfc00, 0xfe80, 0x64, 0x100, 0x2002, 0]) << 112) | rnd.getrandbits(rnd.choice([16, 48, 100]))
        a = ipaddress.IPv6Address(b)
        cases.append(rnd.choice([a.compressed, a.exploded]))
    return cases


def test_classify_matches_python(spark):
    cases = _cases()
    df = spark.createDataFrame([(c,) for c in cases], "src_ip string")
    out = classify_cols(df, role_cols=(("src_ip", "source", "t"),)).collect()
    bad = [(r.src_ip, r.t) for r in out if r.t != py_class(r.src_ip, "source")]
    assert not bad, bad[:10]


def test_single_column_classifier(spark):
    cases = _cases()[:400]
    df = spark.createDataFrame([(c,) for c in cases], "ip string")
    out = df.select("ip", classify_ip("ip", "destination").alias("t")).collect()
    assert all(r.t == py_class(r.ip, "destination") for r in out)


def test_direction_rfc1918(spark):
    nets = [ipaddress.ip_network(n) for n in ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16")]
    cases = [c for c in _cases() if c is None or ":" not in c] + ["10.1.0.0/16", "10.0.0.0/7", "172.16.0.0/12"]

    def expected(c):
        try:
            n = ipaddress.ip_network(c, strict=False)
        except (ValueError, TypeError):
            return "Outbound"
        if "/" not in c and not all(x == str(int(x)) for x in c.split(".")):
            return "Outbound"
        return "Inbound" if any(n.subnet_of(m) for m in nets) else "Outbound"

    df = spark.createDataFrame([(c,) for c in cases], "dest_ip string")
    out = with_direction(df).collect()
    bad = [(r.dest_ip, r.direction) for r in out if r.direction != expected(r.dest_ip)]
    assert not bad, bad[:10]
