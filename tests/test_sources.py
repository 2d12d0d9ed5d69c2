import calendar
import gzip
import math

import pytest

from tidegrid.sources import ionex, lzw, text_tables

LATS = [87.5 - 2.5 * k for k in range(71)]
LONS = [-180 + 5.0 * k for k in range(73)]


def compress(data: bytes, most: int = 12) -> bytes:
    """A plain writer of the compress format, for round trips."""
    table = {bytes([i]): i for i in range(256)}
    codes, width, group = [], 9, []
    out = bytearray(b"\x1f\x9d" + bytes([0x80 | most]))

    def flush(full):
        bits = sum(c << (k * width) for k, c in enumerate(group))
        n = 8 if full else len(group)
        out.extend(bits.to_bytes(-(-n * width // 8), "little"))
        group.clear()

    def put(code):
        group.append(code)
        if len(group) == 8:
            flush(True)

    size, word = 257, b""
    for b in data:
        nxt = word + bytes([b])
        if nxt in table:
            word = nxt
            continue
        put(table[word])
        if size < 1 << most:
            table[nxt] = size
            size += 1
            if size > 1 << width and width < most:
                if group:
                    flush(True)
                width += 1
        word = bytes([b])
    if word:
        put(table[word])
    if group:
        flush(False)
    return bytes(out)


def line(payload: str, label: str) -> str:
    return f"{payload:<60}{label:<20}"


def field(lat, lon):
    return 12.5 + lat / 20 + 6 * math.cos(math.radians(2 * lon + lat))


def text(stamps, exponent=True, missing=None):
    out = [line("    -1", "EXPONENT")] if exponent else []
    out += [line("  87.5 -87.5  -2.5", "LAT1 / LAT2 / DLAT"), line("  -180.0 180.0   5.0", "LON1 / LON2 / DLON"), line("", "END OF HEADER")]
    for n, s in enumerate(stamps):
        out += [line(f"{n + 1:6d}", "START OF TEC MAP"), line("".join(f"{x:6d}" for x in s), "EPOCH OF CURRENT MAP")]
        for lat in LATS:
            out.append(line(f"  {lat:6.1f}-180.0 180.0   5.0 450.0", "LAT/LON1/LON2/DLON/H"))
            vals = [9999 if missing == (lat, lon) else round(field(lat, lon) * 10) for lon in LONS]
            out += ["".join(f"{v:5d}" for v in vals[k : k + 16]) for k in range(0, 73, 16)]
        out.append(line(f"{n + 1:6d}", "END OF TEC MAP"))
    return "\n".join([*out, line("     1", "START OF RMS MAP")])


def test_maps_epochs_and_missing_cells(spark, tmp_path):
    stamps = [(2015, 1, 1, 0, 0, 0), (2015, 7, 1, 24, 0, 0)]
    (tmp_path / "a.txt").write_text(text(stamps, missing=(87.5, 0.0)))
    (tmp_path / "b.gz").write_bytes(gzip.compress(text(stamps[:1], exponent=False).encode()))
    (tmp_path / "c.Z").write_bytes(compress(text(stamps[1:]).encode()))
    rows = ionex.read_maps(spark, str(tmp_path)).collect()
    assert sorted(r.epoch_s for r in rows) == sorted(
        [calendar.timegm((2015, 1, 1, 0, 0, 0)), calendar.timegm((2015, 7, 2, 0, 0, 0))] * 2
    )
    assert sum(x is None for r in rows for y in r.grid for x in y) == 2
    assert all(abs(r.grid[10][7] - field(LATS[10], LONS[7])) < 0.051 for r in rows)


def test_data_source(spark, tmp_path):
    (tmp_path / "a.txt").write_text(text([(2015, 3, 8, h, 0, 0) for h in range(3)]))
    ionex.register(spark)
    t = sorted(r.epoch_s for r in spark.read.format("ionex").load(str(tmp_path)).collect())
    assert [b - a for a, b in zip(t, t[1:])] == [3600, 3600]


@pytest.mark.parametrize("most", [9, 10, 12, 16])
def test_lzw_round_trip(most):
    import random

    random.seed(most)
    for n in (0, 1, 10, 1000, 60000):
        data = bytes(random.choice(b"abcab \n") for _ in range(n))
        assert lzw.expand(compress(data, most)) == data


def test_unknown_ending_fails():
    with pytest.raises(ValueError):
        lzw.to_text("a.bin", b"")


def driver_line(width=49, **at):
    f = ["0"] * width
    f[:4] = ["2015", "32", "1", "5"]
    for k, v in at.items():
        f[int(k[1:])] = v
    return "  ".join(f)


def test_driver_lines(spark):
    df = spark.createDataFrame([(driver_line(_13="9999.99", _21="450.5", _25="999.98"),), ("",)], "value string")
    (r,) = text_tables.parse_drivers(df).collect()
    assert r.t == calendar.timegm((2015, 2, 1, 1, 5, 0)) and r.b_magnitude is None and r.flow_speed == 450.5 and r.proton_density == 999.98
    with pytest.raises(Exception, match="another number of fields"):
        text_tables.parse_drivers(spark.createDataFrame([(driver_line(46),)], "value string")).collect()


def index_line(day, kps, obs, adj, width=28):
    f = ["0"] * width
    f[:3] = ["2015", "1", str(day)]
    f[7:15] = [str(k) for k in kps]
    if width > 27:
        f[25], f[26], f[27] = str(obs), str(adj), "2"
    return " ".join(f)


def test_index_lines(spark):
    rows = [(0, "# a comment"), (1, index_line(1, [2.667, -1.0, 2.333, 0, 0, 0, 0, 9.0], 120.5, -1.0)), (2, ""), (3, index_line(2, [0] * 8, 1, 1, 20))]
    df = text_tables.parse_indices(spark.createDataFrame(rows, "line int, value string"))
    (r,) = df.collect()
    assert (r.f107_obs, r.f107_adj, r.definitive, r.kp[1]) == (120.5, None, 2, None)
    kp = {x.t: x.kp for x in text_tables.kp_steps(df).collect()}
    assert len(kp) == 7 and kp[calendar.timegm((2015, 1, 1, 0, 0, 0))] == 2.7 and kp[calendar.timegm((2015, 1, 1, 6, 0, 0))] == 2.3
    with pytest.raises(ValueError):
        text_tables.parse_indices(spark.createDataFrame([(0, "1 2 3")], "line int, value string")).collect()
