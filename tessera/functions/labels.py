"""Category labels of providers and queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text

#: Labels of each category, in the order in which equally long ones are tried. Fixed values.
BUCKETS = {
    "food": "restaurant|cafe|fast_food|bar|pub|food_court|biergarten|ice_cream|bakery|quán ăn|quán nước|nhà hàng|tiệm ăn|quán cafe|cà phê|quán bia|ăn uống",
    "retail": "supermarket|convenience|marketplace|shop|mall|department_store|clothes|shoes|electronics|mobile_phone|furniture|hardware|greengrocer|butcher|siêu thị|cửa hàng|chợ|tạp hóa|đại lý|phụ tùng|điện tử|điện thoại|điện máy|máy tính|hiệu sách|nhà sách",
    "health": "pharmacy|hospital|clinic|doctors|dentist|veterinary|nhà thuốc|phòng khám|bệnh viện|trạm y tế|hiệu thuốc|bác sĩ|nha sĩ|y tế|dịch vụ y tế|sức khỏe|phòng mạch|châm cứu|dược phẩm",
    "education": "school|university|college|kindergarten|language_school|trường học|đại học|mầm non|trung tâm",
    "lodging": "hotel|guest_house|hostel|motel|resort|homestay|khách sạn|nhà nghỉ|chỗ ở",
    "tourism": "attraction|museum|viewpoint|di tích|công viên|du lịch",
    "transport": "fuel|charging_station|bus_station|bus_stop|parking|car_wash|car_repair|bicycle_parking|bến xe|trạm xăng|ga|sân bay|gara|rửa xe|sơn ô tô|độ xe|cứu hộ",
    "finance": "bank|atm|money_transfer|ngân hàng|insurance|bảo hiểm",
    "government": "townhall|courthouse|police|fire_station|post_office|community_centre|public_building|ủy ban|ubnd|công an|văn phòng chính phủ",
    "services": "hairdresser|beauty|laundry|dry_cleaning|tailor|optician|travel_agency|real_estate|spa|gym|fitness_centre|kim hoàn|dịch vụ máy tính",
    "worship": "place_of_worship|church|pagoda|temple|mosque|chùa|đình|miếu|nhà thờ",
    "culture": "theatre|cinema|arts_centre|library|rạp chiếu phim|rạp hát|giải trí",
    "office": "office|company|coworking|văn phòng|nhà xuất bản",
    "industrial": "factory|warehouse|xưởng",
}
#: Labels of one map service's types. Fixed values.
TYPES = {
    "lodging": "lodging", "food": "food|meal_takeaway|meal_delivery", "retail": "store|liquor_store|grocery_or_supermarket|convenience_store|car_dealer|electronics_store|furniture_store|hardware_store|jewelry_store|pet_store|shoe_store|clothing_store|book_store",
    "health": "drugstore|doctor|veterinary_care", "education": "primary_school|secondary_school", "transport": "gas_station|transit_station|subway_station|train_station|airport", "tourism": "tourist_attraction",
    "government": "local_government_office|city_hall|embassy", "services": "real_estate_agency|beauty_salon|hair_care",
}
PAYLOAD_KEYS = ("category", "amenity", "shop", "office", "tourism", "leisure")


def _plain(s: str) -> str:
    import unicodedata

    return " ".join("".join(c for c in unicodedata.normalize("NFD", s.lower()).replace("đ", "d") if not unicodedata.combining(c)).split())


def table() -> dict[str, str]:
    """Folded label to category."""
    return {_plain(k): bucket for source in (BUCKETS, TYPES) for bucket, names in source.items() for k in names.split("|")}


def candidates(raw: Column, payload: Column) -> Column:
    """Labels in order: the raw one, known keys of the payload (JSON), its types."""
    named = [F.get_json_object(payload, f"$.{k}") for k in PAYLOAD_KEYS]
    types = F.coalesce(F.from_json(F.get_json_object(payload, "$.types"), "array<string>"), F.array().cast("array<string>"))
    return F.concat(F.array_compact(F.array(F.nullif(raw, F.lit("")), *named)), types)


def _lookup(label: Column, known: dict[str, str]) -> Column:
    exact = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    parts = sorted((k for k in known if len(k) > 3), key=len, reverse=True)
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(known[k]).alias("v")) for k in parts])

    def found(folded: Column) -> Column:
        return F.coalesce(F.try_element_at(exact, folded), F.get(F.filter(pairs, lambda p: folded.contains(p.k)), F.lit(0)).v)

    return text.let(text.fold_diacritics(F.trim(F.lower(label))), found)


def category(labels: Column, known: dict[str, str] | None = None) -> Column:
    """Of the first label that has one: by the whole folded label, else by its longest known part of over three characters."""
    known = known or table()
    return F.get(F.filter(F.transform(labels, lambda x: _lookup(x, known)), lambda c: c.isNotNull()), F.lit(0))


def resolved(labels: Column, provider: Column, overlay: dict[tuple[str, str], str]) -> Column:
    """As category(), with (provider, folded label) -> category laid over the table: a provider's own, else
    those of '*', else the table's."""
    common = table() | {k: v for (p, k), v in overlay.items() if p == "*"}
    out = category(labels, common)
    for name in sorted({p for p, _ in overlay if p != "*"}):
        out = F.when(provider == name, category(labels, common | {k: v for (p, k), v in overlay.items() if p == name})).otherwise(out)
    return out


def unknown_labels(records: DataFrame, overlay: dict[tuple[str, str], str] | None = None) -> DataFrame:
    """Records (seq, provider, raw): raw labels that nothing maps: provider, label (folded), sample, seen."""
    label = F.trim(F.coalesce("raw", F.lit("")))
    rows = records.withColumn("label", label).where((F.col("label") != "") & resolved(F.array("label"), F.coalesce("provider", F.lit("")), overlay or {}).isNull())
    return rows.groupBy(F.coalesce("provider", F.lit("")).alias("provider"), text.fold_diacritics(F.lower("label")).alias("folded")).agg(F.substring(F.min_by("label", "seq"), 1, 200).alias("sample"), F.count("*").alias("seen"))


#: Hints in a folded query, by category. Fixed values.
HINTS = {
    "food": "nha hang|quan an|quan nuoc|quan ca phe|ca phe|cafe|coffee|pho|bun|com|banh mi|an uong|restaurant|restaurants|bar|pub",
    "retail": "sieu thi|cua hang|tap hoa|cho|shop|store|market|supermarket|mall|convenience store",
    "health": "nha thuoc|hieu thuoc|phong kham|benh vien|tram y te|nha khoa|thu y|pharmacy|drugstore|clinic|hospital|dentist",
    "education": "truong hoc|dai hoc|mam non|truong|school|university|kindergarten",
    "lodging": "khach san|nha nghi|homestay|hotel|hostel|resort",
    "tourism": "di tich|museum|attraction",
    "transport": "tram xang|cay xang|ben xe|nha ga|san bay|gas station|fuel|parking|bus station|airport|train station",
    "finance": "ngan hang|atm|bank|banking",
    "government": "uy ban|ubnd|cong an|buu dien|post office|police",
    "services": "cat toc|tiem cat toc|salon|spa|gym|phong gym|giat ui|sua chua|garage",
    "worship": "chua|nha tho|dinh|mieu|temple|pagoda|church",
    "culture": "rap chieu|cinema|thu vien|library",
}


def hint(folded: Column, hints: dict[str, str] | None = None) -> Column:
    """hints: phrase -> category; the longest phrase that the folded query holds, the first of equals."""
    hints = hints or {h: c for c, names in HINTS.items() for h in names.split("|")}
    return F.coalesce(*[F.when(folded.contains(h), hints[h]) for h in sorted(hints, key=len, reverse=True)])
