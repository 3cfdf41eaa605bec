"""Small listings tables made by hand or by a seeded generator."""

import datetime
import random

from hearthlens.schema import LISTINGS

DEFAULTS = {
    "name": "Loft",
    "host_id": 1,
    "host_name": "Ann",
    "host_since": datetime.date(2010, 1, 1),
    "host_is_superhost": "f",
    "host_neighbourhood": "Harlem",
    "neighbourhood": "New York",
    "neighbourhood_cleansed": "Harlem",
    "neighbourhood_group_cleansed": "Manhattan",
    "property_type": "Entire home",
    "room_type": "Entire home/apt",
    "accommodates": 2,
    "bathrooms_text": "1 bath",
    "bedrooms": 1.0,
    "price": "$100.00",
    "availability_30": 5.0,
    "availability_60": 10.0,
    "availability_90": 15.0,
    "availability_365": 90.0,
    "number_of_reviews": 20,
    "review_scores_rating": 4.5,
    "review_scores_accuracy": 4.5,
    "review_scores_cleanliness": 4.5,
    "review_scores_checkin": 4.5,
    "review_scores_communication": 4.5,
    "review_scores_location": 4.5,
    "review_scores_value": 4.5,
    "instant_bookable": "f",
}


def rows_of(*changes):
    names = LISTINGS.fieldNames()
    made = []
    for i, change in enumerate(changes):
        row = dict.fromkeys(names) | DEFAULTS | {"id": i} | change
        made.append(row)
    return made


def listings(spark, *changes):
    rows = rows_of(*changes)
    return spark.createDataFrame([tuple(r[n] for n in LISTINGS.fieldNames()) for r in rows], LISTINGS)


def random_changes(seed, n=300):
    """Rows over small domains, so that titles, hosts and places repeat, with NULLs in every column used."""
    rng = random.Random(seed)

    def maybe(value, p=0.15):
        return None if rng.random() < p else value

    areas = ["Harlem", "Chelsea", "Astoria", "Flushing"]
    return [
        {
            "name": maybe("Hot" if rng.random() < 0.33 else rng.choice(["a", "b", "c", "d", "e"]), 0.05),
            "host_id": rng.randrange(8),
            "host_name": maybe(rng.choice(["Ann", "Bo", "Cy", "Di"])),
            "host_neighbourhood": maybe(rng.choice(areas)),
            "neighbourhood": maybe("x"),
            "neighbourhood_cleansed": rng.choice(areas),
            "neighbourhood_group_cleansed": rng.choice(["Manhattan", "Queens"]),
            "host_is_superhost": maybe(rng.choice("tf")),
            "instant_bookable": maybe(rng.choice("tf")),
            "room_type": rng.choice(["Private room", "Shared room", "Hotel room"]),
            "price": maybe(rng.choice(["$0.00", "$50.00", "$1,234.50", "$80.00", "", "$abc"])),
            "number_of_reviews": maybe(rng.choice([0, 5, 10, 11, 40])),
            "review_scores_rating": maybe(rng.choice([0.0, 0.5, 1.0, 2.5, 3.0, 4.99, 5.0, 5.5])),
            "review_scores_accuracy": maybe(rng.choice([1.0, 4.0, 5.0]), 0.3),
            "review_scores_cleanliness": maybe(rng.choice([1.0, 4.0, 5.0]), 0.3),
            "host_response_rate": maybe(rng.choice([0.0, 0.5, 1.0])),
            "host_acceptance_rate": maybe(rng.choice([0.25, 0.75])),
            "availability_30": maybe(float(rng.randrange(3))),
            "availability_60": maybe(float(rng.randrange(60))),
            "host_since": maybe(datetime.date(2000 + rng.randrange(3), 1, 1)),
            "accommodates": rng.randrange(4),
        }
        for _ in range(n)
    ]


def money(text):
    """The money rule in plain Python, for the brute-force checks."""
    if text is None:
        return None
    digits = text.removeprefix("$").replace(",", "")
    if not digits.strip():
        return 0.0
    try:
        return float(digits)
    except ValueError:
        return None
