"""Values of the racing domain as columns: times, keys, prices, distances, race attributes, ladders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from railside.functions.text import normalize_text

# Lengths of margins by abbreviation.
MARGINS = {"snk": 0.2, "nk": 0.3, "sht-hd": 0.1, "shd": 0.1, "hd": 0.2, "nse": 0.05, "dht": 0.0, "dist": 30.0}

# Ground descriptions by surface.
SURFACES = {
    "AW": ("Slow", "Standard", "Standard To Fast", "Standard To Slow"),
    "Dirt": ("Fast", "Muddy", "Sloppy"),
    "Turf": ("Firm", "Good", "Good To Firm", "Good To Soft", "Good To Yielding", "Hard", "Heavy", "Holding", "Soft", "Soft To Heavy", "Very Soft", "Yielding", "Yielding To Soft"),
}

# Race classes by their old letters.
CLASS_LETTERS = {"a": "1", "b": "2", "c": "3", "d": "4", "e": "5", "f": "6", "g": "6", "h": "7"}

# Phrases of race names, first match wins, and the sexes that they admit.
SEX_PHRASES = (("colts & fillies", "C & F"), ("fillies & mares|filles & mares", "F & M"), (r"colts & geldings|colts/geldings|\(c & g\)", "C & G"), (r"\(mares & geldings\)", "M & G"), ("fillies", "F"), ("mares", "M"))

# Phrases of race names over jumps (of at least 2400 metres), later ones win.
JUMP_PHRASES = (("NH Flat", "national hunt flat|nh flat race|mares flat race|inh bumper| sales bumper|kepak flat race|i\\.n\\.h\\. flat race"), ("Hurdle", r" hurdle|\(hurdle\)"), ("Chase", r" chase|\(chase\)|steeplechase|steeple-chase|steeplchase|steepl-chase"))

FURLONG, MILE, YARD = 201.168, 1609.34, 0.914


def hhmm(text: Column) -> Column:
    """HH:MM of H:MM, HH:MM, HH:MM:SS, HMM and HHMM; anything else unchanged."""
    t = F.trim(text)
    colon = F.concat(F.lpad(F.split(t, ":")[0], 2, "0"), F.lit(":"), F.split(t, ":")[1])
    return F.when(t.rlike(r"^\d{1,2}:\d{2}(:\d{2})?$"), colon).when(t.rlike(r"^\d{3,4}$"), F.concat(F.left(F.lpad(t, 4, "0"), F.lit(2)), F.lit(":"), F.right(t, F.lit(2)))).otherwise(text)


def minutes(text: Column) -> Column:
    """Minutes after midnight of a time, null if it is none."""
    t = hhmm(text)
    return F.when(t.rlike(r"^\d{2}:\d{2}$"), F.left(t, F.lit(2)).cast("int") * 60 + F.right(t, F.lit(2)).cast("int"))


def clock(minute: Column) -> Column:
    m = F.pmod(minute, F.lit(1440))
    return F.concat(F.lpad(F.floor(m / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((m % 60).cast("string"), 2, "0"))


def time_variants(text: Column) -> Column:
    """The time, a minute before and a minute after, around midnight too."""
    m = minutes(text)
    return F.array(clock(m), clock(m - 1), clock(m + 1))


def minutes_apart(a: Column, b: Column) -> Column:
    """Minutes between two times; null where one cannot be read."""
    return F.abs(minutes(a) - minutes(b))


def event_time(text: Column) -> Column:
    """Timestamp of DD-MM-YYYY HH:MM, null otherwise."""
    return F.try_to_timestamp(text, F.lit("dd-MM-yyyy HH:mm"))


def venue(menu: Column) -> Column:
    """The venue of a menu hint: what stands before the first digit."""
    return F.trim(F.regexp_extract(menu, "^([^0-9]+)[0-9]", 1))


def status(off: Column, as_of: Column) -> Column:
    """Finished half an hour after the off (UTC timestamps), Active from ten minutes before it."""
    return F.when(as_of > off + F.expr("INTERVAL 30 MINUTES"), "Finished").when(as_of > off - F.expr("INTERVAL 10 MINUTES"), "Active").otherwise("Upcoming")


def freshness(stamp: Column, as_of: Column) -> Column:
    age = (F.unix_timestamp(as_of) - F.unix_timestamp(stamp)) / 60
    return F.when(stamp.isNull(), "No price").when(age < 5, "Fresh").when(age < 60, "Current").otherwise("Stale")


def leading_position(text: Column) -> Column:
    return F.regexp_extract(text, "^([0-9]+)", 1).try_cast("int")


def won(text: Column) -> Column:
    """Whether the position starts with the number 1; never null."""
    return F.coalesce(leading_position(text) == 1, F.lit(False))


def key_of(*parts: Column) -> Column:
    """MD5 of the parts joined by pipes; null parts are empty."""
    return F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def race_key(day: Column, region: Column, course: Column, off: Column, name: Column, kind: Column) -> Column:
    """Of all parts normalised, so that feeds of different spelling meet."""
    return key_of(day, *[normalize_text(c) for c in (region, course)], hhmm(off), *[normalize_text(c) for c in (name, kind)])


def runner_key(race: Column, horse: Column, num: Column, draw: Column) -> Column:
    """By number, or by draw where there is none."""
    return key_of(race, normalize_text(horse), F.coalesce(F.nullif(num, F.lit(0)), F.nullif(draw, F.lit(0))))


def number_of(text: Column, digits: int = 2) -> Column:
    """A number without currency signs, thousands commas and dashes; null if none remains."""
    return F.round(F.regexp_replace(text, "[£€$,–-]", "").try_cast("double"), digits)


def sound_price(price: Column) -> Column:
    """Decimal odds, null below the smallest that an exchange offers."""
    return F.when(price >= 1.01, price)


def known(value: Column) -> Column:
    """Null for 0."""
    return F.nullif(value, F.lit(0))


def pounds(text: Column) -> Column:
    """Stones and pounds, st-lb, in pounds."""
    return F.split(text, "-")[0].try_cast("int") * 14 + F.try_element_at(F.split(text, "-"), F.lit(2)).try_cast("int")


def _fractions(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("¼"), F.lit(".25")), F.lit("½"), F.lit(".5")), F.lit("¾"), F.lit(".75"))


def furlongs(text: Column) -> Column:
    """Of 1m2f, 2m, 6f, 7½f."""
    t = _fractions(F.trim(text))
    miles, rest = F.regexp_extract(t, r"^(\d+)m", 1).try_cast("double"), F.regexp_extract(t, r"(\d*\.?\d+)f$", 1).try_cast("double")
    return F.when(miles.isNotNull() | rest.isNotNull(), F.coalesce(miles, F.lit(0.0)) * 8 + F.coalesce(rest, F.lit(0.0)))


def metres(text: Column) -> Column:
    """Of 1m2f110yds, rounded."""
    t = F.lower(text)
    parts = [F.coalesce(F.regexp_extract(t, rf"(\d+){unit}", 1).try_cast("double"), F.lit(0.0)) * size for unit, size in (("m", MILE), ("f", FURLONG), ("yds", YARD))]
    return F.round(parts[0] + parts[1] + parts[2]).cast("int")


def beaten_lengths(text: Column) -> Column:
    """A margin in lengths: names, halves and quarters, decimals."""
    t = F.lower(F.trim(text))
    out = F
    for name, value in MARGINS.items():
        out = out.when(t == name, F.lit(value))
    return out.otherwise(_fractions(t).try_cast("double"))


def full_margin(own: Column, overall: Column) -> Column:
    """The overall margin, with a short own one added that it leaves out."""
    return F.when((overall > 1) & (own < 0.25), own + overall).otherwise(overall)


def lengths_per_second(going: Column, course: Column, flat: Column) -> Column:
    """How many lengths a second is worth: fewer on slow ground and over jumps."""
    g = F.lower(going)
    base = F.when(flat, 6.0).otherwise(5.0)
    quick = g.isin("firm", "standard", "hard", "fast") | (flat & g.isin("slow", "sloppy"))
    slow_course = F.lower(course).contains("southwell")
    return F.when(F.coalesce(g, F.lit("")) == "", base).when(quick, base - F.when(slow_course, 1.0).otherwise(0.0)).when(g.contains("good"), base).when(g.isin("soft", "heavy", "yielding", "holding", "slow"), base - 1).otherwise(F.lit(5.0))


def seconds(text: Column) -> Column:
    """Of m:ss.cc, rounded to hundredths."""
    return F.round(F.split(text, ":")[0].try_cast("double") * 60 + F.try_element_at(F.split(text, ":"), F.lit(2)).try_cast("double"), 2)


def decimal_odds(text: Column) -> Column:
    """Fractional odds with marks of favourites as decimal odds."""
    t = F.regexp_replace(F.lower(F.trim(text)), "[fjc]+$", "")
    quotient = F.try_divide(F.split(t, "/")[0].try_cast("double"), F.try_element_at(F.split(t, "/"), F.lit(2)).try_cast("double"))
    return F.when(t.isin("evens", "evs", "evn"), F.lit(2.0)).otherwise(F.round(quotient + 1, 2))


def surface_of(going: Column) -> Column:
    out = F
    for surface, names in SURFACES.items():
        out = out.when(going.isin(*names), surface)
    return out.otherwise("")


def race_class(name: Column) -> Column:
    """Class 1 to 7 of a race name, old letters translated."""
    found = F.lower(F.regexp_extract(name, r"(?i)\(?class ([a-h0-9])\)?", 1))
    letters = F.create_map(*[F.lit(x) for pair in CLASS_LETTERS.items() for x in pair])
    number = F.coalesce(letters[found], found)
    return F.when(found != "", F.concat(F.lit("Class "), number)).when(F.lower(name).contains("(premier handicap)"), "Class 2").otherwise("")


def race_pattern(name: Column) -> Column:
    """Group or grade, or listed."""
    found = F.initcap(F.regexp_extract(name, r"(?i)\(?((group|grade) ([0-9]|[ivx]+))\)?", 1))
    return F.when(found != "", found).when(F.lower(name).rlike(r"listed race|\(listed"), "Listed").otherwise("")


def bands(text: Column) -> tuple[Column, Column]:
    """(ages, ratings) of a bracketed list such as (3yo+, 0-75)."""
    parts = F.transform(F.split(F.regexp_replace(text, r"^\(|\)$", ""), ","), lambda x: F.trim(x))
    first = lambda test: F.coalesce(F.try_element_at(F.filter(parts, test), F.lit(1)), F.lit(""))
    return first(lambda x: x.contains("yo")), first(lambda x: ~x.contains("yo") & x.contains("-"))


def sex_restriction(name: Column) -> Column:
    n, out = F.lower(name), F
    for phrase, label in SEX_PHRASES:
        out = out.when(n.rlike(phrase), label)
    return out.otherwise("")


def race_type(name: Column, metres_: Column, code: Column | None = None, fences: Column | None = None) -> Column:
    """Flat, or over what a race is run.

    A race of the flat code is one unless it is a National Hunt flat race; then what stands in the way
    tells, then the name of a race of at least 2400 metres.
    """
    n, out = F.lower(name), F
    if code is not None:
        out = out.when((F.lower(code) == "flat") & ~n.contains("national hunt flat"), "Flat")
    if fences is not None:
        out = out.when(F.lower(fences).contains("hurdle"), "Hurdle").when(F.lower(fences).contains("fence"), "Chase")
    for label, phrase in reversed(JUMP_PHRASES):
        out = out.when((metres_ >= 2400) & n.rlike(phrase), label)
    return out.otherwise("Flat")


def completed(position: Column, value: Column) -> Column:
    """The value where the position is a number or a disqualification, else null."""
    return F.when(position.rlike("^[0-9]+$") | (position == "DSQ"), value)


def weighted_price(traded: Column, back: Column, lay: Column) -> Column:
    """Traded volume's mean price of arrays of (price, size); else the mid of the best offers; else 0."""
    volume = F.aggregate(traded, F.lit(0.0), lambda a, x: a + x["size"])
    money = F.aggregate(traded, F.lit(0.0), lambda a, x: a + x["price"] * x["size"])
    b, l = F.try_element_at(back, F.lit(1))["price"], F.try_element_at(lay, F.lit(1))["price"]
    return F.coalesce(F.try_divide(money, volume), (b + l) / 2, F.lit(0.0))


def best_back(back: Column, last_traded: Column) -> Column:
    """The best offer, else the last traded price."""
    return F.coalesce(F.try_element_at(back, F.lit(1))["price"], last_traded)
