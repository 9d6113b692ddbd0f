"""The MaxMind DB source on files that the test writes: every record size, both address families, all types of values."""

import ipaddress
import struct

import pytest

from webstrata.operators import geo
from webstrata.sources import mmdb


class Writer:
    """Values are written once; later ones are pointers to the first."""

    def __init__(self):
        self.data, self.seen = b"", {}

    def control(self, kind, size):
        more = b""
        if size >= 65821:
            size, more = 31, (size - 65821).to_bytes(3, "big")
        elif size >= 285:
            size, more = 30, (size - 285).to_bytes(2, "big")
        elif size >= 29:
            size, more = 29, bytes([size - 29])
        return (bytes([kind << 5 | size]) if kind < 8 else bytes([size, kind - 7])) + more

    def pointer(self, to):
        for n, low in ((1, 0), (2, 2048), (3, 526336)):
            if to - low < 1 << 8 * n + 3:
                return bytes([1 << 5 | n - 1 << 3 | (to - low) >> 8 * n]) + ((to - low) & (1 << 8 * n) - 1).to_bytes(n, "big")
        return bytes([1 << 5 | 3 << 3]) + to.to_bytes(4, "big")

    def encoded(self, v):
        if isinstance(v, bool):
            return self.control(14, int(v))
        if isinstance(v, str):
            raw = v.encode()
            return self.control(2, len(raw)) + raw
        if isinstance(v, float):
            return self.control(3, 8) + struct.pack(">d", v)
        if isinstance(v, int) and v < 0:
            return self.control(8, 4) + struct.pack(">i", v)
        if isinstance(v, int):
            raw = v.to_bytes((v.bit_length() + 7) // 8, "big")
            return self.control(5 if len(raw) <= 2 else 6 if len(raw) <= 4 else 9 if len(raw) <= 8 else 10, len(raw)) + raw
        if isinstance(v, list):
            return self.control(11, len(v)) + b"".join(map(self.place, v))
        return self.control(7, len(v)) + b"".join(self.place(k) + self.place(x) for k, x in v.items())

    def place(self, v):
        """An inner value: a pointer if it was written before and is long enough."""
        key = repr(v)
        if key not in self.seen:
            raw = self.encoded(v)
            self.seen[key] = len(self.data)
            self.data += raw
        return self.pointer(self.seen[key]) if len(key) > 3 else self.encoded(v)

    def record(self, v):
        raw = self.encoded(v)
        at = len(self.data)
        self.data += raw
        return at


def write(path, networks, size, version, aliases=True):
    """networks: CIDR to record; longer ones within shorter ones split them."""
    nodes = [[None, None]]
    writer, records = Writer(), {}
    for cidr, value in sorted(networks.items(), key=lambda x: ipaddress.ip_network(x[0]).prefixlen):
        net = ipaddress.ip_network(cidr)
        bits, length = int(net.network_address), net.prefixlen
        total = 32 if version == 4 else 128
        if version == 6 and net.version == 4:
            length += 96
        if repr(value) not in records:
            records[repr(value)] = ("r", writer.record(value))
        node = 0
        for d in range(length):
            side = bits >> (total - 1 - d) & 1
            if d == length - 1:
                nodes[node][side] = records[repr(value)]
            else:
                if not isinstance(nodes[node][side], int):
                    nodes.append([nodes[node][side]] * 2)
                    nodes[node][side] = len(nodes) - 1
                node = nodes[node][side]
    if version == 6 and aliases:  # ::ffff:0:0/96 leads where ::/96 does
        node = 0
        for _ in range(96):
            node = nodes[node][0]
        four, node = node, 0
        for d in range(96):
            side = 0xFFFF >> (95 - d) & 1 if d >= 80 else 0
            if d == 95:
                nodes[node][side] = four
            else:
                if not isinstance(nodes[node][side], int):
                    nodes.append([nodes[node][side]] * 2)
                    nodes[node][side] = len(nodes) - 1
                node = nodes[node][side]
    count = len(nodes)
    number = lambda x: count if x is None else x if isinstance(x, int) else count + 16 + x[1]
    tree = b""
    for left, right in nodes:
        a, b = number(left), number(right)
        if size == 28:
            tree += (a & 0xFFFFFF).to_bytes(3, "big") + bytes([a >> 24 << 4 | b >> 24]) + (b & 0xFFFFFF).to_bytes(3, "big")
        else:
            tree += a.to_bytes(size // 8, "big") + b.to_bytes(size // 8, "big")
    meta = {"node_count": count, "record_size": size, "ip_version": version, "database_type": "Test", "build_epoch": 1_700_000_000, "languages": ["en"]}
    own = Writer()
    own.place = own.encoded  # metadata without pointers
    path.write_bytes(tree + bytes(16) + writer.data + mmdb.MARKER + own.encoded(meta))


def city(code, name, n):
    return {"country": {"iso_code": code, "names": {"en": name, "de": name + " (de)"}}, "city": {"names": {"en": f"City {n}"}}, "location": {"latitude": n + 0.5, "longitude": -n - 0.25, "time_zone": "Etc/UTC"}, "postal": {"code": str(n)}, "subdivisions": [{"names": {"en": f"Region {n}"}}], "extra": [True, False, n * 70000, -n, 2**70, "x" * (n * 150)]}


FOUR = {"10.0.0.0/8": city("AA", "Aland", 1), "10.3.0.0/16": city("BB", "Bland", 2), "10.3.128.0/17": city("CC", "Cland", 3), "192.0.2.1/32": {"autonomous_system_number": 64500, "autonomous_system_organization": "Org"}, "0.0.0.0/2": city("AA", "Aland", 1)}
SIX = {"2001:db8::/32": city("DD", "Dland", 4), "2001:db8:1::/48": city("BB", "Bland", 2)}


def found_in(networks, ip):
    a = ipaddress.ip_address(ip)
    own = [ipaddress.ip_network(n) for n in networks]
    fits = [n for n in own if n.version == a.version and a in n]
    return networks[str(max(fits, key=lambda n: n.prefixlen))] if fits else None


@pytest.mark.parametrize("size", [24, 28, 32])
@pytest.mark.parametrize("version", [4, 6])
def test_networks(spark, tmp_path, size, version):
    networks = FOUR if version == 4 else FOUR | SIX
    f = tmp_path / "x.mmdb"
    write(f, networks, size, version)
    for parts in (None, 3):
        table = mmdb.read_mmdb(spark, str(f), partitions=parts)
        rows = table.collect()
        nets = [ipaddress.ip_network(r.network) for r in rows]
        assert not any(a.version == b.version and a.overlaps(b) for i, a in enumerate(nets) for b in nets[:i])
        for ip in ("10.1.2.3", "10.3.0.1", "10.3.200.1", "192.0.2.1", "192.0.2.2", "1.1.1.1", "2001:db8::1", "2001:db8:1::5", "2001:db9::1"):
            want = found_in(networks, ip)
            [got] = [r for r, n in zip(rows, nets, strict=True) if ipaddress.ip_address(ip) in n] or [None]
            assert (got is None) == (want is None), ip
            if want and "country" in want:
                assert (got.country_code, got.country_name, got.city, got.region, got.latitude, got.longitude, got.postal_code, got.timezone, got.asn) == (want["country"]["iso_code"], want["country"]["names"]["en"], want["city"]["names"]["en"], want["subdivisions"][0]["names"]["en"], want["location"]["latitude"], want["location"]["longitude"], want["postal"]["code"], "Etc/UTC", None)
            elif want:
                assert (got.asn, got.asn_org, got.country_code) == (64500, "Org", None)
    assert mmdb.metadata(str(f))["database_type"] == "Test"


def test_lookup_and_own_columns(spark, tmp_path):
    f = tmp_path / "y.mmdb"
    write(f, FOUR | SIX, 28, 6)
    table = mmdb.read_mmdb(spark, f.as_uri(), "network string, `country.names.de` string, `extra.2` long, `extra.5` string, `city` string, none double")
    rows = spark.createDataFrame([(ip,) for ip in ("10.3.200.1", "2001:db8::1", "::ffff:10.1.1.1", "9.9.9.9", "255.0.0.1", "bad", None)], "ip_address string")
    named = table.toDF("network", "german", "big", "long_text", "city", "none")
    got = {r.ip_address: (r.german, r.big, r.city, None if r.long_text is None else len(r.long_text), r.none) for r in geo.locate(rows, geo.networks(named)).collect()}
    assert got == {"10.3.200.1": ("Cland (de)", 210000, "City 3", 450, None), "2001:db8::1": ("Dland (de)", 280000, "City 4", 600, None), "::ffff:10.1.1.1": (None,) * 5, "9.9.9.9": ("Aland (de)", 70000, "City 1", 150, None), "255.0.0.1": (None,) * 5, "bad": (None,) * 5, None: (None,) * 5}


def test_broken_files(tmp_path):
    f = tmp_path / "z.mmdb"
    f.write_bytes(b"no such file")
    with pytest.raises(ValueError):
        mmdb.metadata(str(f))


def test_parts_hold_every_network_once(tmp_path):
    f = tmp_path / "w.mmdb"
    write(f, {f"10.{i}.{i * 7 % 256}.0/24": {"n": i} for i in range(200)} | {f"2001:db8:{i:x}::/48": {"n": i} for i in range(100)}, 24, 6)
    tree = mmdb.Tree(f.read_bytes())
    whole = sorted(x for root in tree.roots() for x in tree.networks(root))
    assert len(whole) == 300 and all("::ffff" not in n for n, _ in whole)
    for parts in (1, 2, 7, 50, 1000):
        starts = tree.split(parts)
        assert sorted(x for s in starts for x in tree.networks(s)) == whole and len(starts) >= min(parts, 100)
