import gzip
import json
from datetime import date

from pyspark.sql import functions as F

from municipia.operators import sync
from municipia.plans import views
from municipia.sources import osm, registry
from municipia.operators import geocode
from municipia.streaming import sync_stream


def test_listing_files(spark, tmp_path):
    doc = {"url": "https://h/d/77/f.pdf", "mimeType": "application/pdf", "filename": "f", "size": "9"}
    one = {"commune": "c", "total": 2, "actes": [{"numero": "AT 1/26", "objet": "a  b", "dateDecision": "2026-01-02", "datePublication": None, "documentPrincipal": None, "annexes": [doc]}, {"numero": "AR 2/26", "objet": "x", "dateDecision": "2026-01-02", "annexes": []}]}
    two = {"commune": "c", "total": 2, "actes": [{"numero": " at 3 / 26 ", "objet": None, "dateDecision": "2026-05-06", "datePublication": "2026-05-07T01:00", "annexes": None}, {"numero": "AT 4/19", "objet": "", "dateDecision": "2019-01-01"}]}
    for k, page in enumerate((one, two)):
        (tmp_path / f"p{k}.json").write_text(json.dumps(page))
    acts = {r["id"]: r for r in registry.select_decrees(registry.read_listing(spark, str(tmp_path)), 2026).collect()}
    assert set(acts) == {"77", "at-3-26-2026-05-07"}
    assert acts["77"]["date_publication"] == date(2026, 1, 2) and acts["77"]["pdf_taille"] == "9"
    signature = registry.select_decrees(registry.read_listing(spark, str(tmp_path)), 2026).select("id", registry.fingerprint(*[F.col(c) for c in ("numero", "objet", "date_decision", "pdf_url", "pdf_taille")]).alias("s"))
    assert {r["id"]: r["s"] for r in signature.collect()}["77"] == "AT 1/26|a b|2026-01-02|f.pdf|9"


def test_pdf_files_and_texts(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.pdf").write_bytes(b"<html>")
    good, bad = registry.read_pdf_files(spark, str(tmp_path))
    assert (good.count(), bad.count()) == (1, 1)
    pages = spark.createDataFrame([("c", 1, 2, "y" * 90, None), ("c", 1, 1, "short", "ocr page"), ("c", 2, 1, "", None), ("c", 3, 1, "z" * 80, "no")], "commune string, act_id int, page_no int, native_text string, ocr_text string")
    got = {r["act_id"]: (r["text"], r["method"]) for r in registry.document_texts(pages).collect()}
    assert got == {1: ("ocr page\n\f\n" + "y" * 90, "mixte"), 2: ("", "vide"), 3: ("z" * 80, "natif")}


def test_map_sources(spark, tmp_path):
    geometry = [{"lat": 1.0, "lon": 2.0}, {"lat": 1.0, "lon": 3.0}]
    elements = [
        {"type": "way", "id": 1, "tags": {"highway": "residential", "name": "Rue A"}, "geometry": geometry},
        {"type": "node", "id": 2, "lat": 1.0, "lon": 2.0, "tags": {"name": "Mairie", "amenity": "townhall"}},
        {"type": "relation", "id": 3, "tags": {}, "members": [{"type": "way", "role": "outer", "geometry": geometry}]},
        {"type": "way", "id": 4, "tags": {"highway": "service"}, "geometry": geometry},
    ]
    with gzip.open(tmp_path / "x.json.gz", "wt") as f:
        json.dump({"commune": "c", "elements": elements}, f)
    ways, places, members = osm.read_overpass(spark, str(tmp_path))
    assert [(r["id"], r["name"]) for r in ways.collect()] == [(1, "Rue A")]
    assert [(r["id"], r["kind"]) for r in places.collect()] == [("n2", "amenity")]
    assert members.count() == 1
    xml = tmp_path / "m.osm"
    xml.write_text('<osm><node id="1" lat="1" lon="2"/><node id="2" lat="1" lon="3"><tag k="name" v="N"/></node><way id="9"><nd ref="2"/><nd ref="1"/><nd ref="7"/><tag k="highway" v="residential"/><tag k="name" v="Rue B"/></way><way id="8"><nd ref="1"/><tag k="landuse" v="grass"/></way></osm>')
    nodes, refs = osm.read_osm_xml(spark, str(xml), "c")
    rows = osm.resolve_ways(nodes, refs).collect()
    assert [(r["id"], [(p["x"], p["y"]) for p in r["coords"]]) for r in rows] == [(9, [(3.0, 1.0), (2.0, 1.0)])]
    osm.save_reference(ways, str(tmp_path / "ref"))
    assert osm.load_reference(spark, str(tmp_path / "ref"), ways.schema).count() == 1


def state(spark, rows):
    return spark.createDataFrame(rows, sync_stream.STATE)


def row(i, statut="publie", motif="", manual=False, error="", attempts=1, signature="s", gone=None, before=(None, None), published=date(2026, 1, 1)):
    return ("c", str(i), f"{i}/2026", published, published, statut, motif, manual, error, attempts, (signature, gone, *before))


def listed(spark, ids, signature="s"):
    return spark.createDataFrame([("c", str(i), f"{i}/2026", "", date(2026, 1, 1), date(2026, 1, 1), signature, date(2026, 3, 1)) for i in ids], sync_stream.SNAPSHOT)


def after(spark, rows, ids, signature="s"):
    found = sync_stream.next_state(state(spark, rows), listed(spark, ids, signature), 2026, sync_stream.ingest_as_published)
    return {int(r["id"]): r for r in found.collect()}


def test_an_act_vanishes_and_comes_back(spark):
    one = after(spark, [row(i) for i in range(10)], range(1, 10))
    assert one[0]["statut"] == "masque" and one[0]["motif_verification"] == "Retiré du registre officiel (constaté le 01/03/2026)"
    assert one[0]["suivi_registre"]["statut_avant"] == "publie" and one[1]["statut"] == "publie"
    back = after(spark, [tuple(one[i]) for i in range(10)], range(10))
    assert back[0]["statut"] == "publie" and back[0]["suivi_registre"]["retire_le"] is None


def test_an_edited_act_comes_back_as_it_was(spark):
    gone = row(0, "masque", "Retiré du registre officiel (constaté le 01/02/2026)", True, gone=date(2026, 2, 1), before=("a_verifier", "voir"))
    assert (after(spark, [gone], [0])[0]["statut"], after(spark, [gone], [0])[0]["motif_verification"]) == ("a_verifier", "voir")
    decided = row(0, "masque", "décidé", True, gone=date(2026, 2, 1), before=("publie", ""))
    assert after(spark, [decided], [0])[0]["motif_verification"] == "décidé"


def test_a_mass_disappearance_is_ignored(spark):
    assert {r["statut"] for r in after(spark, [row(i) for i in range(10)], [0, 1]).values()} == {"publie"}
    assert {r["statut"] for r in after(spark, [row(i) for i in range(3)], []).values()} == {"publie"}


def test_changed_acts_are_read_again(spark):
    got = after(spark, [row(0), row(1, manual=True), row(2, "masque", manual=True), row(3, signature=None)], range(4), "t")
    assert [got[i]["suivi_registre"]["signature"] for i in range(4)] == ["t"] * 4
    assert [got[i]["statut"] for i in range(4)] == ["publie", "a_verifier", "masque", "publie"]
    assert got[3]["tentatives"] == 1 and got[0]["tentatives"] == 2


def test_failed_acts_are_tried_three_times(spark):
    got = after(spark, [row(0, error="x", attempts=2), row(1, error="x", attempts=3)], range(2))
    assert (got[0]["erreur"], got[1]["erreur"]) == ("", "x")


def test_old_acts_are_not_tracked(spark):
    assert after(spark, [row(0, published=date(2019, 1, 1)), row(1)], [1])[0]["statut"] == "publie"


def test_missing_columns_and_journal(spark):
    old = spark.createDataFrame([("c", "1", "n")], "commune string, id string, numero string")
    new = spark.createDataFrame([("c", "2", "m", "lieu")], "commune string, id string, numero string, lieu string")
    assert sorted((r["id"], r["lieu"]) for r in sync.upsert(old, new).collect()) == [("1", None), ("2", "lieu")]
    summary = spark.createDataFrame([("c", "todo", 2), ("c", "same", 9), ("d", "back", 1)], "commune string, outcome string, n long")
    log = {r["commune"]: (r["nouveaux"], r["message"]) for r in sync.journal_row(summary, F.lit(1), F.lit(2), "manuel").collect()}
    assert log == {"c": (2, "2 à traiter"), "d": (0, "1 réapparu(s) au registre")}


def test_views_hide_what_is_private(spark):
    fields = [f for f in views.PUBLIC if f not in ("jours", "horaires", "remarques", "etat")]
    df = spark.range(1).select(F.lit("c").alias("commune"), *[F.lit(None).cast("date" if f.startswith("date") else "string").alias(f) for f in fields], F.expr("named_struct('jours', array(date'2026-01-01'), 'horaires', array('7h00'), 'remarques', array())").alias("calendrier"), F.lit("secret").alias("texte"), *[F.lit("x").alias(c) for c in views.ADMIN])
    shown = views.public_view(df, F.lit("2026-01-01").cast("date"))
    assert "texte" not in shown.columns and "objet_registre" not in shown.columns and len(shown.columns) == 20
    admin = views.admin_view(df, F.lit("2026-01-01").cast("date"))
    assert "geojson" not in admin.columns and "objet_registre" in admin.columns
    assert json.loads(shown.select(F.to_json(F.struct("*"))).first()[0])["etat"] == "inconnu"


def test_labels_of_periods(spark):
    d = lambda s: F.lit(s).cast("date")
    none, days = F.array().cast("array<date>"), F.array(d("2026-10-02"), d("2026-10-03"))
    r = spark.range(1).select(
        views.period_label(d("2026-10-02"), d("2026-10-03"), days, d("2026-10-01")), views.period_text(d("2026-10-09"), d("2026-10-30"), none), views.state_text(d("2026-10-01"), d("2026-10-01"), d("2026-10-01")),
        views.hours_per_day(days, F.array(F.lit("7h00–8h30"), F.lit("9h00–10h00"))), views.hour_notes(none, F.array(F.lit("7h00"), F.lit("hors week-end"), F.lit("du lundi au vendredi")), F.array().cast("array<string>")),
        views.list_order(d("2026-01-01"), d("2026-02-01"), d("2026-10-01")),
    ).first()
    assert r[0] == "2 et 3 oct." and r[1] == "Du vendredi 9 octobre 2026 au vendredi 30 octobre 2026" and r[2] == "En cours, dernier jour aujourd'hui"
    assert [x["hours"] for x in r[3]] == ["7h–8h30", "9h–10h"] and r[4] == ["7h", "du lundi au vendredi"] and r[5] == "z79739798"


def test_a_run_without_new_snapshots(spark, tmp_path):
    folder = f"file://{tmp_path}/decrees"
    listed(spark, range(3), "s").write.mode("append").parquet(f"file://{tmp_path}/in")
    first = sync_stream.run_available(spark, f"file://{tmp_path}/in", folder, 2026)
    again = sync_stream.run_available(spark, f"file://{tmp_path}/in", folder, 2026)
    assert sorted(map(str, again.collect())) == sorted(map(str, first.collect())) and again.count() == 3


def test_missing_coordinates_are_refused(spark):
    rows = spark.createDataFrame([(1.0, 2.0, ["Point"]), (None, 2.0, None), (1.0, 95.0, ["Circle"])], "lon double, lat double, types array<string>")
    got = rows.select(geocode.lonlat_error(rows["lon"], rows["lat"]), geocode.geojson_error(rows["types"], rows["types"])).collect()
    assert [(a is None, b is None) for a, b in got] == [(True, True), (False, False), (False, False)]
