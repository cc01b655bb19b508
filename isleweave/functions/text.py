"""Text functions on columns: city names, question slots, places named in texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Written forms of city names and the names they stand for.
CITY_ALIASES = {
    "col": "Colombo", "colombo city": "Colombo", "mt lavinia": "Mount Lavinia", "mt. lavinia": "Mount Lavinia", "mount-lavinia": "Mount Lavinia",
    "nuwaraeliya": "Nuwara Eliya", "nuwara-eliya": "Nuwara Eliya", "nuwara eliya city": "Nuwara Eliya", "kandy city": "Kandy", "galle city": "Galle",
    "negombo city": "Negombo", "bentota beach": "Bentota", "trinco": "Trincomalee",
}
#: Cities whose numbered postal zones are one city.
ZONED_CITIES = ["colombo", "dehiwala", "mount lavinia"]
#: The same for the invented island of the tables.
ISLAND_ALIASES = {"mt saliya": "Mount Saliya", "mt. saliya": "Mount Saliya", "mount-saliya": "Mount Saliya", "nelueliya": "Nelu Eliya", "nelu-eliya": "Nelu Eliya"}
ISLAND_ZONED = ["kolavara"]

#: Amenities with the words that mention them.
AMENITIES = {
    "pool": ["pool", "swimming"], "wifi": ["wifi", "wi-fi", "internet"], "spa": ["spa", "wellness"], "gym": ["gym", "fitness"], "parking": ["parking", "car park"],
    "restaurant": ["restaurant", "dining"], "bar": ["bar", "lounge"], "air conditioning": ["air conditioning", "ac ", "a/c", "air-conditioned"],
    "beach access": ["beachfront", "beach access", "private beach"], "pet friendly": ["pet friendly", "pet-friendly", "pets allowed"],
    "airport shuttle": ["airport shuttle", "shuttle"], "breakfast": ["breakfast included", "free breakfast"],
}
#: Attractions a question may ask for.
ASKED_ATTRACTIONS = [
    "beach", "lake", "river", "park", "temple", "church", "mosque", "museum", "mall", "market", "airport", "train station", "railway station", "bus station", "hospital", "university",
    "stadium", "fort", "palace", "waterfall", "mountain", "hill", "zoo", "spa", "casino", "golf", "botanical", "harbour", "port", "city center", "city centre",
]
#: Words in descriptions and the kinds of attraction they mean, in order.
ATTRACTIONS = {
    "beach": "Beach", "lake": "Lake", "river": "River", "park": "Park", "temple": "Temple", "church": "Church", "mosque": "Mosque", "museum": "Museum",
    "mall": "Shopping Mall", "market": "Market", "airport": "Airport", "railway station": "Train Station", "train station": "Train Station",
    "bus station": "Bus Station", "bus stand": "Bus Station", "hospital": "Hospital", "university": "University", "stadium": "Stadium", "fort": "Fort",
    "palace": "Palace", "shrine": "Shrine", "harbour": "Harbour", "harbor": "Harbour", "port": "Port", "waterfall": "Waterfall", "mountain": "Mountain",
    "hill": "Hill", "zoo": "Zoo", "resort": "Resort Area", "spa": "Spa", "casino": "Casino", "golf": "Golf Course", "botanical": "Botanical Garden",
}
#: Phrases of a question by what they tell.
QUIET = ["quiet", "calm", "peaceful", "secluded", "tranquil", "relaxing", "away from"]
CLOSE = ["walkable", "walking distance", "close to", "near the", "next to", "in the heart"]
TRAFFIC = ["avoid traffic", "low traffic", "no traffic", "easy access", "good road", "stable eta", "quick access", "fast access"]
ACCESS = ["accessible", "accessibility", "easy to reach", "good access", "transport"]
TOP_RATED = ["top-rated", "top rated", "highly rated", "best rated", "highest rated"]
CHEAP = ["cheap", "budget", "affordable", "lowest price", "least expensive"]
LUXURY = ["top-rated", "highest rated", "best rated", "luxury", "5 star", "five star"]
#: Words of a question that are no keyword.
QUESTION_STOPS = [
    "the", "a", "an", "in", "near", "with", "and", "or", "for", "hotels", "hotel", "good", "best", "top", "show", "find", "me", "that", "have", "has", "are", "is", "to", "of", "which", "what", "where",
    "i", "want", "looking", "recommend", "please", "some", "any", "around",
]
#: How questions name amounts, stars and ratings.
AT_MOST = r"(?:under|below|less than|cheaper than|max|up to|within)\s*(?:rs\.?|lkr|\$)?\s*(\d{3,7})"
AT_LEAST = r"(?:over|above|more than|at least|min|minimum)\s*(?:rs\.?|lkr|\$)?\s*(\d{3,7})"
BETWEEN = r"between\s*(?:rs\.?|lkr|\$)?\s*(\d{3,7})\s*(?:and|-|to)\s*(?:rs\.?|lkr|\$)?\s*(\d{3,7})"
STARS = r"(\d(?:\.\d)?)\s*\+?\s*(?:star|stars)"
RATING = r"rating\s*(?:above|over|of|>=?)?\s*(\d(?:\.\d)?)"
#: Country names that are no neighbourhood.
COUNTRIES = ["sri lanka", "india", "thailand", "malaysia", "singapore", "maldives", "indonesia", "vietnam", "cambodia", "nepal"]
#: How a text names a place nearby. The end is taken by the group, so that no look-ahead is needed.
NEARBY = [
    r"(?:near|close\s+to|next\s+to|adjacent\s+to|opposite)\s+(?:the\s+)?([A-Z][A-Za-z\s]{2,35}?)(?:[,.\n]|$)",
    r"(?:located\s+in|situated\s+in|in)\s+(?:the\s+)?([A-Z][A-Za-z\s]{2,30}?)\s+(?:district|area|zone|neighbourhood|neighborhood|region|quarter)",
    r"walking\s+distance\s+from\s+(?:the\s+)?([A-Z][A-Za-z\s]{2,35}?)(?:[,.\n]|$)",
    r"\d+\s+minutes?\s+(?:from|to)\s+(?:the\s+)?([A-Z][A-Za-z\s]{2,35}?)(?:[,.\n]|$)",
]

STRINGS = "array<string>"


def any_of(text: Column, phrases: list[str]) -> Column:
    """True where ``text`` contains a phrase; false for null texts."""
    hit = F.lit(False)
    for p in phrases:
        hit = hit | F.contains(text, F.lit(p))
    return F.coalesce(hit, F.lit(False))


def picked(pairs: list[tuple[str, Column]]) -> Column:
    """Array of the names whose condition holds, in order, each once."""
    chosen = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in pairs]), lambda x: x.isNotNull())
    return F.array_distinct(chosen).cast(STRINGS)


def _extract(text: Column, shape: str, group: int = 1) -> Column:
    found = F.regexp_extract(text, shape, group)
    return F.when(found != "", found)


def canonical_city(name: Column, aliases: dict[str, str] | None = None, zoned: list[str] | None = None) -> Column:
    """One name per city: without postal code, zone number of a zoned city and stray blanks; aliases resolved; title case.

    Null and "" stay as they are.
    """
    aliases, zoned = aliases or CITY_ALIASES, ZONED_CITIES if zoned is None else zoned
    low = F.lower(F.trim(F.regexp_replace(name, r"\s+", " ")))
    low = F.trim(F.regexp_replace(low, r"[,\s]+\d{4,6}$", ""))
    base = F.trim(F.regexp_extract(low, r"^(.*?)[\s-]+\d{1,3}$", 1))
    low = F.when(base.isin(zoned), base).otherwise(low)
    known = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return F.when(name.isNull() | (name == ""), name).otherwise(F.coalesce(F.try_element_at(known, low), F.initcap(low)))


def island_city(name: Column) -> Column:
    """``canonical_city`` with the names of the tables' island; a trailing "city" is dropped."""
    return canonical_city(F.regexp_replace(name, r"(?i)\s+city\s*$", ""), ISLAND_ALIASES, ISLAND_ZONED)


def price_bounds(question: Column) -> tuple[Column, Column]:
    """Least and greatest price that a question names, as doubles or null."""
    t = F.replace(F.lower(question), F.lit(","), F.lit(""))
    num = lambda c: c.cast("double")
    a, b = num(_extract(t, BETWEEN, 1)), num(_extract(t, BETWEEN, 2))
    both = a.isNotNull() & b.isNotNull()
    return F.when(both, F.least(a, b)).otherwise(num(_extract(t, AT_LEAST))), F.when(both, F.greatest(a, b)).otherwise(num(_extract(t, AT_MOST)))


def rating_bounds(question: Column) -> tuple[Column, Column]:
    """Least rating and least star that a question names; a top-rated phrase alone means 4.0."""
    t = F.lower(question)
    rating = _extract(t, RATING).cast("double")
    rating = F.when(any_of(t, TOP_RATED), F.coalesce(F.when(rating != 0, rating), F.lit(4.0))).otherwise(rating)
    return rating, F.floor(_extract(t, STARS).cast("double")).cast("int")


def amenities(text: Column) -> Column:
    """Amenities that a text mentions, by containment of any of their words ("spa" in "space" counts)."""
    t = F.lower(text)
    return picked([(name, any_of(t, words)) for name, words in AMENITIES.items()])


def asked_attractions(question: Column) -> Column:
    t = F.lower(question)
    return picked([(k, any_of(t, [k])) for k in ASKED_ATTRACTIONS])


def attraction_kinds(text: Column) -> Column:
    t = F.lower(text)
    return picked([(label, any_of(t, [k])) for k, label in ATTRACTIONS.items()])


def keywords(question: Column, most: int = 12) -> Column:
    """The first words of three or more letters that are no stop word, repeats kept."""
    words = F.regexp_extract_all(F.lower(question), F.lit("[a-z]{3,}"), F.lit(0))
    return F.slice(F.filter(words, lambda w: ~w.isin(QUESTION_STOPS)), 1, most)


def intent(question: Column, city: Column) -> Column:
    """A question as a struct: city, amenities, attractions, bounds, proximity, access, traffic, sort, keywords."""
    t = F.lower(question)
    low, high = price_bounds(question)
    rating, star = rating_bounds(question)
    quiet, access = any_of(t, QUIET), any_of(t, ACCESS)
    traffic = quiet | any_of(t, TRAFFIC)
    sort = F.when(any_of(t, CHEAP), "cheapest").when(any_of(t, LUXURY), "highest_rated").when(access | traffic, "most_accessible").otherwise("best_overall")
    return F.struct(
        city.alias("city"), amenities(question).alias("amenities"), asked_attractions(question).alias("attractions"), low.alias("min_price"), high.alias("max_price"),
        rating.alias("min_rating"), star.alias("min_star"), F.when(quiet, "far").when(any_of(t, CLOSE), "close").otherwise("any").alias("proximity"),
        F.when(access, "high").otherwise("normal").alias("access"), traffic.alias("avoid_traffic"), sort.alias("sort"), keywords(question).alias("keywords"),
    )


def neighbourhoods(address: Column, city: Column, most: int = 2) -> Column:
    """Parts of an address that may be neighbourhoods: no number, no country, not the city, four letters or more, each once."""
    parts = F.filter(F.transform(F.split(address, r"[,/|]"), lambda p: F.trim(p)), lambda p: (F.length(p) >= 4) & ~p.rlike(r"^[\d\s-]+$") & ~p.rlike(r"^[A-Za-z]{1,3}\.?$"))
    parts = F.filter(parts, lambda p: (F.lower(p) != F.lower(F.trim(F.coalesce(city, F.lit(""))))) & ~F.lower(p).isin(COUNTRIES))
    first = F.filter(parts, lambda p, i: F.array_position(F.transform(parts, F.lower), F.lower(p)) == i + 1)
    return F.slice(first, 1, most)


def landmarks(text: Column, most: int = 6) -> Column:
    """Places that a text names as nearby, in the order of the patterns, each once whatever its case."""
    found = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in NEARBY]))
    names = F.filter(F.transform(found, lambda n: F.rtrim(F.trim(n), F.lit(".,;"))), lambda n: (F.length(n) >= 4) & n.rlike("[A-Z]"))
    first = F.filter(names, lambda n, i: F.array_position(F.transform(names, F.lower), F.lower(n)) == i + 1)
    return F.slice(first, 1, most)


def url_host(url: Column) -> Column:
    """The third part between slashes, or null."""
    return F.get(F.split(url, "/"), F.lit(2))


def unfenced(text: Column) -> Column:
    """A text without the code fence around it, trimmed."""
    inner = _extract(text, r"(?s)```(?:json)?\s*\n?(.*?)\n?```")
    return F.trim(F.coalesce(inner, text))
