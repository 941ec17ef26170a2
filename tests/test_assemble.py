import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from flowspark.operators.assemble import assemble_flows
from flowspark.schemas import PACKET_SCHEMA

T0 = datetime(2024, 1, 1)
FLAGS = ["syn", "ack", "fin", "rst", "psh", "urg"]
BITS = {"fin": 1, "syn": 2, "rst": 4, "psh": 8, "ack": 16, "urg": 32}


def packet(i, s, src, dst, flags=(), size=10, proto=6):
    return (i, T0 + timedelta(seconds=s), src[0], src[1], dst[0], dst[1], proto, size, *[f in flags for f in FLAGS])


def brute_force(rows, timeout):
    """Plain sessionisation, one conversation after the other."""
    talks = {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        a, b = (r[2], r[3]), (r[4], r[5])
        talks.setdefault((min(a, b), max(a, b), r[6]), []).append(r)
    flows = []
    for (_, _, proto), packets in talks.items():
        last = None
        for r in packets:
            if last is None or (r[1] - last) > timedelta(seconds=timeout):
                flows.append([(r[2], r[3]), (r[4], r[5]), proto, 0, 0, 0, 0, r[1], r[1], 0])
            f, last = flows[-1], r[1]
            i = 3 if (r[2], r[3]) == f[0] else 5
            f[i] += 1
            f[i + 1] += r[7]
            f[8] = r[1]
            for name, on in zip(FLAGS, r[8:]):
                f[9] |= BITS[name] if on else 0
    return sorted((*f[0], *f[1], *f[2:7], int((f[8] - f[7]).total_seconds() * 1000 + 1e-6), f[9]) for f in flows)


def assembled(df, timeout, partitions=None):
    out = assemble_flows(df, timeout, partitions).select(
        "src_ip", "src_port", "dst_ip", "dst_port", "protocol", "src2dst_packets", "src2dst_bytes",
        "dst2src_packets", "dst2src_bytes", "bidirectional_duration_ms", F.col("`udps.tcp_flags`"))
    return sorted(tuple(r) for r in out.collect())


A, B = ("10.0.0.1", 1000), ("10.0.0.2", 80)


def test_worked_case(spark):
    rows = [packet(1, 0.0, B, A, ["syn"]), packet(2, 1.0, A, B, ["ack"]), packet(3, 1.999, A, B, ["fin"]), packet(4, 3.0, A, B, ["rst"])]
    got = assembled(spark.createDataFrame(rows, PACKET_SCHEMA), 1.0)
    assert [(f[0], f[5], f[7], f[9], f[10]) for f in got] == [("10.0.0.1", 1, 0, 0, 4), ("10.0.0.2", 1, 2, 1999, 19)]


@pytest.mark.parametrize("seed,partitions", [(1, 1), (2, 5), (3, 16)])
def test_equals_brute_force_with_a_hot_conversation(spark, seed, partitions):
    rng = random.Random(seed)
    hosts = [(f"10.0.0.{i}", 1000 + i % 3) for i in range(6)]
    rows, t = [], 0.0
    for i in range(600):
        t += rng.choice([0.0, 0.2, 0.9, 1.0, 1.2, 4.0])
        a, b = (A, B) if rng.random() < 0.6 else rng.sample(hosts, 2)
        if rng.random() < 0.5:
            a, b = b, a
        rows.append(packet(i, t, a, b, [f for f in FLAGS if rng.random() < 0.2], rng.randrange(1500), rng.choice([6, 17])))
    rng.shuffle(rows)
    got = assembled(spark.createDataFrame(rows, PACKET_SCHEMA), 1.0, partitions)
    assert got == brute_force(rows, 1.0)


def test_one_long_flow_over_many_parts(spark):
    rows = [packet(i, i * 0.5, A if i % 3 else B, B if i % 3 else A) for i in range(200)]
    got = assembled(spark.createDataFrame(rows, PACKET_SCHEMA), 1.0, 9)
    assert len(got) == 1 and got[0][5] + got[0][7] == 200 and got == brute_force(rows, 1.0)


def test_no_packets(spark):
    assert assembled(spark.createDataFrame([], PACKET_SCHEMA), 1.0) == []
