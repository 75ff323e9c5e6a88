import difflib
import random
import time
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from municipia.operators import geocode, geometry, locations, streets
from municipia.plans import geocoding
from municipia.sources import osm

NAMES = ["Rue Centrale", "Impasse Jules Petit", "Chemin de Grange Noire", "Avenue du 8 Mai 1945", "Rue Jean Macon", "Chemin des Bruyères", "Route de Marne", "Rue Comte de Mirabel"]


@pytest.fixture(scope="module")
def keys(spark):
    rows = [("c", n, 100.0, i) for i, n in enumerate(NAMES)]
    return streets.street_keys(spark.createDataFrame(rows, "commune string, name string, length double, seen int")).cache()


def test_keys(keys):
    found = {r["key"]: r["name"] for r in keys.collect()}
    assert found["avenue du 8 mai 45"] == "Avenue du 8 Mai 1945"
    assert found["rue mirabel"] == "Rue Comte de Mirabel"
    assert found["chemin de bruyere"] == "Chemin des Bruyères"


TEXTS = {
    "du 6 au 18 Rue Centrale": "du 6 au 18 Rue Centrale",
    "Chemin de Grange Noire, dans sa portion comprise entre avenue du 8 mai 45 et Rue Jean Macon": "Chemin de Grange Noire, entre Avenue du 8 Mai 1945 et Rue Jean Macon",
    "Route de Marne, entre le chemin des Bruyères et le 300 Route de Marne": "Route de Marne, entre Chemin des Bruyères et le 300 Route de Marne",
    "Route de Marne entre le 300 route de Marne et le chemin des Bruyères": "Route de Marne, entre Chemin des Bruyères et le 300 Route de Marne",
    "à l'angle de la rue Mirabel et de la rue Centrale": "angle de Rue Comte de Mirabel et Rue Centrale",
    "au 61 Rue Jean Macom": "61 Rue Jean Macon",
    "du 14 rue Centrale à l'intersection rue Centrale et impasse Jules Petit": "Rue Centrale, entre Impasse Jules Petit et le 14 Rue Centrale",
    "la circulation, Rue Centrale, en direction de la rue Jean Macon": "Rue Centrale",
    "au 5000 Rue Centrale": "Rue Centrale",
    "rien": None,
}


def test_locations_and_their_wording_read_again(spark, keys):
    df = spark.createDataFrame([("c", i, t) for i, t in enumerate(TEXTS)], "commune string, doc int, text string")
    rows = locations.relocate(df, keys).withColumn("said", locations.location_text("locations")).orderBy("doc").collect()
    assert [r["said"] for r in rows] == list(TEXTS.values())
    again = spark.createDataFrame([("c", r["doc"], r["said"]) for r in rows if r["said"]], "commune string, doc int, text string")
    read = {r["doc"]: r["said"] for r in locations.relocate(again, keys).withColumn("said", locations.location_text("locations")).collect()}
    assert read == {r["doc"]: r["said"] for r in rows if r["said"]}


def test_fuzzy_against_brute_force(spark, keys):
    words = ["rue centralle", "rue jean macom", "impasse jule petitt", "rue inconnue", "chemin des bruyeres"]
    texts = spark.createDataFrame([("c", i, ["le", "long", *w.split(), "ici"]) for i, w in enumerate(words)], "commune string, doc int, words array<string>")
    got = {r["doc"]: (r["n"], r["name"]) for r in streets.fuzzy_matches(texts, keys, streets.exact_matches(texts, keys)).collect()}
    known = [(r["key"], r["name"]) for r in keys.collect()]
    longest = max(len(k.split()) for k, _ in known)
    want = {}
    for i, w in enumerate(words):
        run = [*w.split(), "ici"]
        if any(" ".join(run[:n]) in dict(known) for n in range(2, len(run) + 1)):
            continue
        for n in range(min(longest + 1, len(run)), 1, -1):
            cand = " ".join(run[:n])
            best = max(((difflib.SequenceMatcher(None, cand, k).ratio(), name) for k, name in known if k.split()[0] == run[0] and abs(len(k.split()) - n) <= 1), default=(0, ""))
            if best[0] >= 0.88:
                want[i] = (n, best[1])
                break
    assert got == want


def test_rare_pairs_lose_no_likeness():
    rng, order = random.Random(3), {}
    texts = ["".join(rng.choice("aab ce") for _ in range(rng.randint(1, 14))) for _ in range(700)]
    texts += ["".join(c for c in t if rng.random() > 0.08) + rng.choice(["", "a"]) for t in texts]
    for i, g in enumerate({t[i : i + 2] for t in texts[:500] for i in range(len(t) - 1)}):
        order[g] = i
    for least in (0.88, 0.75):
        numbers = [set(streets.rare_pairs(t, order, least)) for t in texts]
        alike = 0
        for _ in range(120_000):
            i, j = rng.randrange(len(texts)), rng.randrange(len(texts))
            a, b = texts[i], texts[j]
            if i != j and 2 * min(len(a), len(b)) >= least * (len(a) + len(b)) and difflib.SequenceMatcher(None, a, b).ratio() >= least:
                alike += 1
                assert numbers[i] & numbers[j], (a, b)
        assert alike > 200


def test_fuzzy_candidates_of_one_type(spark):
    """A thousand streets of one type in one commune: all rows of brute force, a small share of the pairs, ties by turn."""
    rng = random.Random(5)
    syllables = ["ba", "lo", "mir", "ven", "tou", "che", "gra", "nel", "pi", "sau", "dor", "quin"]
    names = sorted({"Rue " + " ".join("".join(rng.choices(syllables, k=rng.randint(2, 4))) for _ in range(rng.randint(1, 3))) for _ in range(1000)})
    rng.shuffle(names)
    keys = streets.street_keys(spark.createDataFrame([("c", n, 1.0, i) for i, n in enumerate(names)], "commune string, name string, length double, seen long"))
    wrong = [n.lower().replace("o", "0", 1) if i % 2 else n.lower()[:-1] for i, n in enumerate(names[:120])]
    texts = spark.createDataFrame([("c", i, w.split()) for i, w in enumerate(wrong)], "commune string, doc int, words array<string>")
    got = {r.doc: (r.n, r.name, r.score) for r in streets.fuzzy_matches(texts, keys, streets.exact_matches(texts, keys).limit(0)).collect()}
    known = [(r.key, r.name) for r in keys.orderBy("turn").collect()]
    want, pairs, runs = {}, 0, set()
    for i, w in enumerate(wrong):
        for n in range(len(w.split()), 1, -1):
            cand = " ".join(w.split()[:n])
            runs.add(cand)
            alike = [(k, name) for k, name in known if abs(len(k.split()) - n) <= 1]
            score, name = max(((difflib.SequenceMatcher(None, cand, k).ratio(), name) for k, name in alike), key=lambda x: x[0])
            if score >= 0.88:
                want[i] = (n, name, score)
                break
    assert got == want and len(want) > 100
    table = spark.createDataFrame([("c", "rue", c, len(c.split())) for c in runs], "commune string, type string, cand string, n int")
    met = streets.fuzzy_candidates(table, keys.selectExpr("commune", "'rue' AS type", "key", "size(split(key, ' ')) AS size"), 0.88).count()
    assert met < 0.2 * len(runs) * len(known)  # few syllables make many names alike


def test_overlaps(spark):
    df = spark.sql("select array(named_struct('start',4,'end',6,'name','b','score',1D), named_struct('start',0,'end',5,'name','a','score',1D), named_struct('start',5,'end',7,'name','c','score',1D)) as m")
    assert [x["name"] for x in df.select(streets.without_overlaps(F.col("m")).alias("k")).first()["k"]] == ["a", "c"]


def test_local_places_come_first_with_the_maps_geometry(spark):
    places = spark.createDataFrame([("c", "Parc Vert", "G1", 1)], "commune string, name string, geometry string, seen int")
    local = spark.createDataFrame([("c", "Le Parc", ["Grand Parc"], "Parc Vert", "L1"), ("c", "Stade", None, "x", "L2")], "commune string, nom string, alias array<string>, osm_nom string, geometry string")
    index = streets.place_index(places, local)
    assert sorted((r["key"], r["geometry"], r["local"]) for r in index.collect()) == [("grand parc", "G1", True), ("le parc", "G1", True), ("parc vert", "G1", False), ("stade", "L2", True)]
    texts = spark.createDataFrame([("c", 1, "pres du grand parc et du stade".split())], "commune string, doc int, words array<string>")
    assert [r["name"] for r in streets.place_matches(texts, index).collect()] == ["Le Parc"]
    other = spark.createDataFrame([("c", "Stade", None, "y", "L3")], local.schema)
    assert sorted(r["geometry"] for r in streets.override_places(local, other).collect()) == ["L1", "L3"]


LINE = np.array([(0.0, 0.0), (100.0, 0.0), (100.0, 50.0)])


def test_line_helpers():
    assert geometry.nearest(LINE, (40, 3))[:2] == pytest.approx((3, 40))
    assert geometry.cut(LINE, 90, 120).tolist() == [[90, 0], [100, 0], [100, 20]]
    assert geometry.crossing([LINE], [np.array([(50.0, -10.0), (50.0, 10.0)])]).tolist() == [50, 0]
    assert geometry.crossing([LINE], [np.array([(50.0, 10.0), (50.0, 30.0)])]).tolist() == [50, 5]
    assert geometry.crossing([LINE], [np.array([(50.0, 60.0), (50.0, 90.0)])]) is None
    assert geometry.around([LINE], (0, 500)) is None
    merged = geometry.merge([LINE[:2], LINE[1:], np.array([(500.0, 0.0), (600.0, 0.0)])])
    assert sorted(len(m) for m in merged) == [2, 3]


def test_split_street_is_followed_over_its_gap():
    parts = [np.array([(0.0, 0.0), (200.0, 0.0)]), np.array([(220.0, 0.0), (500.0, 0.0)])]
    way = geometry.between(parts, (10, 0), (480, 0))
    assert way[0].tolist() == [0, 0] and way[-1].tolist() == [500, 0]
    assert geometry.along_parts([parts[0], parts[1] + [100, 0]], (10, 0), (580, 0)) is None


def test_clip_and_icons():
    ring = np.array([(0.0, 0.0), (0.0, 100.0), (100.0, 100.0), (100.0, 0.0), (0.0, 0.0)])
    kept = geometry.clip([np.array([(50.0, 50.0), (300.0, 50.0)])], ring)
    assert len(kept) == 1 and kept[0][-1][0] == pytest.approx(130, abs=0.01)
    far = [np.array([(500.0, 500.0), (600.0, 500.0)])]
    assert geometry.clip(far, ring) is far
    bent = np.array([(0.0, 0.0), (0.0, 100.0), (10.0, 100.0), (10.0, 10.0), (100.0, 10.0), (100.0, 0.0), (0.0, 0.0)])
    assert geometry.inside(bent, geometry.inner_point(bent)[None])[0]
    assert geometry.icon_point([LINE], []).tolist() == [75, 0]
    assert geometry.icon_point([], []) is None
    assert len(geometry.rings([ring[:3], ring[2:]])) == 1


def test_geocoding_columns(spark):
    parts = f"array<array<{geocode.POINT}>>"
    s = spark.createDataFrame([("c", "A", [[(0.0, 0.0), (300.0, 0.0)]]), ("c", "B", [[(100.0, -50.0), (100.0, 50.0)]])], f"commune string, name string, parts {parts}")
    pairs = spark.createDataFrame([("c", "A", "B"), ("c", "A", "nowhere")], "commune string, a string, b string")
    assert [tuple(r["point"]) for r in geocode.crossings(pairs, s).collect()] == [(100.0, 0.0)]
    rings = spark.createDataFrame([("c", [[(0.0, -10.0), (0.0, 10.0), (100.0, 10.0), (100.0, -10.0), (0.0, -10.0)]])], f"commune string, rings {geocode.PARTS}")
    kept = {r["name"]: r["parts"] for r in geocode.clipped(s, rings).collect()}
    assert kept["A"][0][-1]["x"] == pytest.approx(130, abs=0.01)
    members = spark.createDataFrame([("c", "outer", [(0.0, 0.0), (0.0, 9.0), (9.0, 9.0)]), ("c", "outer", [(9.0, 9.0), (0.0, 0.0)])], f"commune string, role string, coords array<{geocode.POINT}>")
    assert [len(r) for r in geocode.boundary_rings(members).first()["rings"]] == [4]
    wanted = spark.createDataFrame([("c", "S", 7), ("c", "S", 40)], "commune string, street string, num int")
    known = spark.createDataFrame([("c", "S", 5, 1.0, 1.0), ("c", "S", 9, 2.0, 2.0)], "commune string, street string, number int, x double, y double")
    assert [(r["num"], r["found"]) for r in geocode.address_points(wanted, known).collect()] == [(7, 5)]
    c = spark.createDataFrame([("rue haute", "rue haute", 0.9, "12", 12), ("rue haute", "rue basse", 0.9, "12", 12), ("rue haute", "rue haute", 0.4, "12", 12), ("rue haute", "rue haute", 0.9, "13", 12)], "street string, found_street string, score double, housenumber string, num int")
    assert geocode.valid_candidates(c).count() == 1
    m = spark.createDataFrame([(4.85, 45.67)], "lon double, lat double").select(geocode.to_degrees(geocode.to_metres(F.col("lon"), F.col("lat"), F.lit(4.9), F.lit(45.6)), F.lit(4.9), F.lit(45.6)).alias("p")).first()["p"]
    assert tuple(m) == pytest.approx((4.85, 45.67))


def _reference(spark, pending=None):
    streets = spark.createDataFrame([("c", "Rue A", [[(0.0, 0.0), (300.0, 0.0)]]), ("c", "Rue B", [[(100.0, -50.0), (100.0, 50.0)]]), ("c", "Rue S", [[(0.0, 900.0), (50.0, 900.0)], [(500.0, 900.0), (600.0, 900.0)]])], f"commune string, name string, parts {geocode.PARTS}")
    addresses = spark.createDataFrame([("c", "Rue A", 4, 200.0, 5.0), ("c", "Rue A", 6, 220.0, 5.0), ("c", "Rue A", 20, 9000.0, 9000.0), ("c", "Rue L", 2, 7.0, 7.0), ("c", "Rue B", 5, 103.0, 40.0)], "commune string, street string, number int, x double, y double")
    places = spark.createDataFrame([("c", "Parc", "Polygon", [[(0.0, 0.0), (0.0, 10.0), (10.0, 10.0), (10.0, 0.0), (0.0, 0.0)]])], f"commune string, name string, type string, parts {geocode.PARTS}")
    centres = spark.createDataFrame([("c", 4.0, 45.0)], "commune string, lon0 double, lat0 double")
    return geocoding.Reference(streets, addresses, places, centres, pending)


def _acts(spark, rows):
    return spark.createDataFrame([("c", k, x, d) for k, x, d in rows], f"commune string, id string, localisations array<{locations.LOCATION}>, deviation array<string>")


def _spot(kind, street=None, name=None, anchor=None, start=None, end=None):
    return (kind, street, name, anchor, start, end)


def _at(num, street, num2=None):
    return ("address", num, num2, street, None)


def _drawn(spark, rows, pending=None):
    out = {}
    for r in geocoding.geocoded(_acts(spark, rows), _reference(spark, pending)).collect():
        found = json.loads(r["geojson"])["features"]
        out[r["id"]] = (r["qualite_geo"], [f["geometry"]["type"] for f in found], [f["properties"] for f in found], r["centre"], r["geocodage_incomplet"])
    return out


def test_places_crossings_and_two_streets_are_drawn(spark):
    crossing = ("intersection", None, None, None, ["Rue A", "Rue B"])
    rows = [
        ("place", [_spot("place", name="Parc")], None),
        ("arms", [_spot("point", anchor=crossing)], None),
        ("two", [_spot("segment", start=_at("4", "Rue A"), end=_at("5", "Rue B"))], None),
        ("far", [_spot("point", anchor=_at("20", "Rue A"))], None),
        ("bare", [_spot("point", anchor=_at("2", "Rue L"))], None),
        ("split", [_spot("street", street="Rue S")], ["Rue B", "Rue Z"]),
        ("lost", [_spot("place", name="Ailleurs"), _spot("point", anchor=_at("abc", "Rue Z"))], []),
        ("partly", [_spot("place", name="Ailleurs"), _spot("street", street="Rue A")], None),
        ("none", None, None),
    ]
    got = _drawn(spark, rows)
    assert {k: v[:2] for k, v in got.items()} == {
        "place": ("precise", ["Polygon"]), "arms": ("precise", ["LineString"] * 2), "two": ("precise", ["LineString"] * 2), "far": ("precise", ["Point"]), "bare": ("precise", ["Point"]),
        "split": ("street", ["MultiLineString", "LineString"]), "lost": ("none", []), "partly": ("approx", ["LineString"]), "none": ("none", []),
    }
    assert got["split"][2] == [{"role": "impact"}, {"role": "deviation", "name": "Rue B"}]
    assert got["none"][3] is None and got["lost"][3] is None
    k = geometry.METRES_LON * np.cos(np.radians(45))
    assert got["partly"][3] == pytest.approx([4 + 150 / k, 45.0], abs=1e-6)
    assert got["place"][3] == pytest.approx([4 + 5 / k, 45 + 5 / geometry.METRES_LAT], abs=1e-6)
    assert got["arms"][3] == pytest.approx([4 + 100 / k, 45.0], abs=1e-6)


def test_waiting_addresses_and_no_acts(spark):
    waits = spark.createDataFrame([("c", "Rue A", 4), ("c", "Rue A", 4)], "commune string, street string, num int")
    rows = [("a", [_spot("point", anchor=_at("4", "Rue A"))], None), ("b", [_spot("point", anchor=_at("6", "Rue A", "4")), _spot("street", street="Rue A")], None), ("c", [_spot("point", anchor=_at("6", "Rue A"))], None)]
    assert {k: v[4] for k, v in _drawn(spark, rows, waits).items()} == {"a": True, "b": True, "c": False}
    assert _drawn(spark, []) == {}


def test_map_data_becomes_a_reference(spark, tmp_path):
    """A boundary of two squares: of a street through both, what lies between them is cut out."""
    corners = {1: (0.0, 0.0), 2: (0.0, 0.01), 3: (0.01, 0.01), 4: (0.01, 0.0), 5: (0.03, 0.0), 6: (0.03, 0.01), 7: (0.04, 0.01), 8: (0.04, 0.0), 9: (-0.01, 0.005), 10: (0.02, 0.005), 11: (0.05, 0.005)}
    node = lambda k, p: f'<node id="{k}" lat="{p[1]}" lon="{p[0]}"/>'
    way = lambda k, refs, tags="": f'<way id="{k}">' + "".join(f'<nd ref="{r}"/>' for r in refs) + tags + "</way>"
    road = '<tag k="highway" v="residential"/><tag k="name" v="Rue A"/>'
    relation = '<relation id="1"><member type="way" ref="20" role="outer"/><member type="way" ref="21" role="outer"/><member type="way" ref="22" role=""/><member type="way" ref="23" role="inner"/><tag k="ref:INSEE" v="01001"/></relation><relation id="2"><member type="way" ref="30" role="outer"/><tag k="ref:INSEE" v="9"/></relation>'
    points = '<node id="40" lat="0.005" lon="0.005"><tag k="name" v="Halle"/><tag k="amenity" v="marketplace"/></node><node id="41" lat="0" lon="0"><tag k="name" v="Borne"/></node>'
    path = tmp_path / "m.osm"
    path.write_text("<osm>" + "".join(node(k, p) for k, p in corners.items()) + points + way(20, [1, 2, 3]) + way(21, [3, 4, 1]) + way(22, [5, 6, 7, 8, 5]) + way(23, [1, 2]) + way(30, [9, 10], road) + way(31, [10, 11], road) + relation + "</osm>")
    nodes, refs = osm.read_osm_xml(spark, str(path), "c")
    ways, areas = osm.route_ways(osm.resolve_ways(nodes, refs))
    members = osm.read_osm_boundary(spark, str(path), "c", "01001")
    assert members.count() == 3
    addresses = spark.createDataFrame([("c", "Rue A", 2, 0.005, 0.005)], "commune string, street string, number int, lon double, lat double")
    ref = geocoding.map_reference(ways, areas.unionByName(osm.read_osm_points(spark, str(path), "c")), members, addresses)
    assert tuple(ref.centres.first())[1:] == pytest.approx((0.02, 0.005))
    assert [(r["name"], r["type"]) for r in ref.places.collect()] == [("Halle", "Point")]
    street = ref.streets.first()
    assert len(street["parts"]) == 1 and len(street["within"]) == 2
    assert [p[0]["x"] for p in street["within"]] == pytest.approx([-0.02 * geometry.METRES_LON - 30, 0.01 * geometry.METRES_LON - 30], abs=0.01 + 0.1)
    got = geocoding.geocoded(_acts(spark, [("a", [_spot("point", anchor=_at("2", "Rue A"))], None), ("b", [_spot("place", name="Halle")], None)]), ref).collect()
    assert all(r["centre"] == pytest.approx([0.005, 0.005]) and r["qualite_geo"] == "precise" for r in got) and len(got) == 2
    none = osm.read_osm_boundary(spark, str(path), "c", "00000")
    assert tuple(geocode.map_centres(ways, geocode.boundary_rings(none)).first())[1:] == pytest.approx((0.02, 0.005))


def test_long_streets_are_dealt_to_few_cells(spark):
    point = lambda x, y: {"x": float(x), "y": float(y)}
    rng = random.Random(4)
    lines = [("c", f"s{i}", [[point(rng.uniform(0, 3000), rng.uniform(0, 3000)), point(rng.uniform(0, 3000), rng.uniform(0, 3000))]]) for i in range(60)] + [("c", "long", [[point(-20000, 100), point(20000, 130)]])]
    lines += [("c", f"t{i}", [[point(x, y), point(x + rng.uniform(-50, 50), y + 20)]]) for i in range(200) for x, y in [(rng.uniform(0, 3000), rng.uniform(0, 3000))]]
    table = spark.createDataFrame(lines, f"commune string, name string, parts {geocode.PARTS}")
    segments = table.select("commune", F.col("name").alias("street"), F.struct(F.col("parts")[0][0].alias("a"), F.col("parts")[0][1].alias("b")).alias("s"))
    assert geocode._dealt(segments, 60.0).count() <= 4 * len(lines)
    asked = [("c", i, point(x, y), point(x + rng.uniform(-60, 60), y + rng.uniform(-60, 60))) for i in range(150) for x, y in [(rng.uniform(0, 3000), rng.uniform(0, 3000))]]
    got = {r.id: (r.street, r.away) for r in geocode.common_streets(spark.createDataFrame(asked, f"commune string, id int, p {geocode.POINT}, q {geocode.POINT}"), table).collect()}

    def away(p, a, b):
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        t = max(0.0, min(1.0, ((p["x"] - a["x"]) * dx + (p["y"] - a["y"]) * dy) / max(dx * dx + dy * dy, 1e-12)))
        return ((p["x"] - a["x"] - t * dx) ** 2 + (p["y"] - a["y"] - t * dy) ** 2) ** 0.5

    want = {}
    for _, i, p, q in asked:
        near = [(away(p, *parts[0]) + away(q, *parts[0]), name) for _, name, parts in lines if away(p, *parts[0]) <= 60 and away(q, *parts[0]) <= 60]
        if near:
            want[i] = (min(near)[1], pytest.approx(min(near)[0]))
    assert got == want and len(want) > 50


def test_clip_is_exact():
    """What is kept of random lines, against distances at many points of them."""
    rng = random.Random(6)
    ring = np.array([(0, 0), (100, 0), (100, 40), (60, 50), (100, 60), (100, 100), (0, 100), (0, 0)], float)
    for _ in range(60):
        line = np.array([(rng.uniform(-150, 250), rng.uniform(-150, 250)) for _ in range(rng.randint(2, 5))])
        kept = geometry.clip([line], ring, belt=30.0)
        along = geometry.lengths(line)
        at = np.linspace(0, along[-1], 20_001)
        points = np.column_stack([np.interp(at, along, line[:, k]) for k in (0, 1)])
        within = geometry._within(points, ring, 30.0).mean() * along[-1]
        assert sum(geometry.lengths(x)[-1] for x in kept) == pytest.approx(within if within > 0.1 else along[-1], abs=along[-1] / 2000)


def test_merge_walks_each_line_once():
    n = 20_000
    lines = [np.array([(i, 0.0), (i + 1, 0.0)][:: 1 if i % 3 else -1]) for i in range(n)]
    random.Random(1).shuffle(lines)
    lines += [np.array([(0.0, 5.0), (1.0, 5.0)]), np.array([(1.0, 5.0), (1.0, 6.0)]), np.array([(1.0, 5.0), (2.0, 5.0)])]  # three ends meet
    lines += [np.array([(0, 9), (1, 9)], float), np.array([(1, 9), (0, 8)], float), np.array([(0, 9), (0, 8)], float)]  # a ring
    start = time.time()
    merged = sorted(geometry.merge(lines), key=len)
    assert time.time() - start < 5 and [len(x) for x in merged] == [2, 2, 2, 4, n + 1]
    assert (merged[-2][0] == merged[-2][-1]).all() and abs(np.diff(merged[-1][:, 0])).tolist() == [1.0] * n


def test_numbers_over_ranges(spark):
    from municipia.plans import views

    rows = spark.range(3000).selectExpr("if(id % 3 = 0, null, if(id % 7 = 0, 'b', 'a')) AS g", "id % 50 AS x", "id AS y")
    got = views.numbered(rows, "g", "x", "y").collect()
    for g in (None, "a", "b"):
        mine = sorted((r.x, r.y, r.place) for r in got if r.g == g)
        assert [p for *_, p in mine] == list(range(len(mine)))
