"""Taxonomies and rule tables as small DataFrames.

A taxonomy is an ordered mapping ``category -> [sub_category, ...]``.  As a
table it is ``(category, cat_ord, sub_category, sub_ord)``; its size is fixed
when it is built, so joins against it may broadcast it (see ``MAX_TAXONOMY``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values.  These must equal the reference's for identical results; they
# are listed in their original order.
# ---------------------------------------------------------------------------

# Model taxonomy: 13 categories, 61 entries, 58 distinct sub-categories.
MODEL_TAXONOMY: dict[str, list[str]] = {
    "Auto": ["Gas", "Maintenance", "Upgrades", "Other_Auto"],
    "Baby": ["Diapers", "Formula", "Clothes", "Toys", "Other_Baby"],
    "Clothes": ["Clothes", "Shoes", "Jewelry", "Bags_Accessories"],
    "Entertainment": ["Sports_Outdoors", "Movies_TV", "DateNights", "Arts_Crafts",
                      "Books", "Games", "Guns", "E_Other"],
    "Electronics": ["Accessories", "Computer", "TV", "Camera", "Phone",
                    "Tablet_Watch", "Gaming", "Electronics_misc"],
    "Food": ["Groceries", "FastFood_Restaurants"],
    "Home": ["Maintenance", "Furniture_Appliances", "Hygiene", "Gym",
             "Home_Essentials", "Kitchen", "Decor", "Security", "Yard_Garden", "Tools"],
    "Medical": ["Health_Wellness"],
    "Kids": ["K_Toys"],
    "Personal_Care": ["Hair", "Makeup_Nails", "Beauty", "Massage",
                      "Vitamins_Supplements", "PC_Other"],
    "Pets": ["Pet_Food", "Pet_Toys", "Pet_Med", "Pet_Grooming", "Pet_Other"],
    "Subscriptions_Memberships": ["Entertainment", "Gym", "Sub_Other"],
    "Travel": ["Hotels", "Flights", "Car_Rental", "Activities"],
}

# Summary taxonomy: as above, with B_Clothes under Baby and Rent first under Home.
SUMMARY_TAXONOMY: dict[str, list[str]] = {
    "Auto": ["Gas", "Maintenance", "Upgrades", "Other_Auto"],
    "Baby": ["Diapers", "Formula", "B_Clothes", "Toys", "Other_Baby"],
    "Clothes": ["Clothes", "Shoes", "Jewelry", "Bags_Accessories"],
    "Entertainment": ["Sports_Outdoors", "Movies_TV", "DateNights", "Arts_Crafts",
                      "Books", "Games", "Guns", "E_Other"],
    "Electronics": ["Accessories", "Computer", "TV", "Camera", "Phone",
                    "Tablet_Watch", "Gaming", "Electronics_misc"],
    "Food": ["Groceries", "FastFood_Restaurants"],
    "Home": ["Rent", "Maintenance", "Furniture_Appliances", "Hygiene", "Gym",
             "Home_Essentials", "Kitchen", "Decor", "Security", "Yard_Garden", "Tools"],
    "Medical": ["Health_Wellness"],
    "Kids": ["K_Toys"],
    "Personal_Care": ["Hair", "Makeup_Nails", "Beauty", "Massage",
                      "Vitamins_Supplements", "PC_Other"],
    "Pets": ["Pet_Food", "Pet_Toys", "Pet_Med", "Pet_Grooming", "Pet_Other"],
    "Subscriptions_Memberships": ["Entertainment", "Gym", "Sub_Other"],
    "Travel": ["Hotels", "Flights", "Car_Rental", "Activities"],
}

# Retailer category paths -> category (effective values: 'Souvenirs' 'Other'
# is one string in the source).
AMAZON_CATEGORY_RULES: dict[str, list[str]] = {
    "Auto": ["Automotive |"],
    "Bdays Holidays": [],
    "Charity": [],
    "Clothes": ["Clothing, Shoes & Jewelry |"],
    "Entertainment": ["Arts, Crafts & Sewing |"],
    "Electronics": ["Computer", "TV", "PC", "Sound", "Camera", "Phone", "Gaming", "Other"],
    "Food": ["Grocery & Gourmet Food |"],
    "Home": ["Health & Household | Household Supplies |", "Home & Kitchen | Bedding |"],
    "Medical": [],
    "Kids": ["Baby Products |"],
    "Personal_Care": ["Beauty & Personal Care |"],
    "Pets": ["Pet_Food", "Pet Toys", "Pet Grooming", "Pet Med", "Pet Other"],
    "Subscriptions_Memberships": ["Entertainment", "Gym", "Sub_Other"],
    "Utilities": ["Electricity", "Water", "Internet", "Phone", "Gas", "Trash"],
    "Vacation": ["Hotels", "Flights", "Rental Cars", "Activities", "SouvenirsOther"],
    "Savings": ["Savings", "College Fund", "Investments", "Emergency", "Retirement", "Other"],
}

# Retailer path fragments -> sub-category.  'Electronics' is listed twice in
# the source; the second list is the effective one, kept at the first position.
RETAILER_SUB_RULES: dict[str, list[str]] = {
    "Other-Auto": ["Off-Road", "Auto Interior", "Auto Electronics", "Automotive Interior",
                   "Auto Detailing", "Auto & Tires"],
    "Maintenance/Fees": ["Auto & Tires|Automotive Replacement Parts",
                         "Automotive Tools & Equipment", "Oils and FLuids", "Motorcycle",
                         "Oil and Fluids", "Tires"],
    "Baby": ["Baby|B", "Baby|C", "Baby|Diapering", "Baby|N", "Baby|Feeding", "Baby|Strollers",
             "Baby Bath", "Baby Gates", "Baby Health Care", "Baby Monitors", "Baby Proofing",
             "Babyproofing", "Child Proof", "Playards", "Toddlers Room", "Toddler"],
    "Misc/Entertainment": ["Sewing", "Musical Instruments"],
    "Electronics": ["Computers", "Projection Equipment", "Health|"],
    "Movies/TV/Music": ["Movies & TV", "Music|"],
    "Clothes/Jewelry": ["Clothing|", "Jewelry|"],
    "Groceries": ["Food|", "Keto Diet", "Fitness|Protein Bars", "Fitness | Protein Shakes",
                  "Superfoods & Cleanses", "Diet Shakes", "MCT Oil", "Meal Replacements",
                  "Ensure |", "On-the-Go Nutrition"],
    "Health-Related": ["First Aid", "Ear Care|", "Eye Care|", "Foot Care", "Gas Relief",
                       "Home Health Care", "Laxatives", "Lip Care", "Medicine Cabinet",
                       "Pain Relievers", "Health Essentials"],
    "Furniture/Appliances": ["Home|Furniture", "Furniture"],
    "Office": ["Office Supplies", "Office"],
    "Decor": ["Home|Decor", "Home|Bedding", "Home|Bath", "Home|Appliances", "Kids Rooms",
              "Kitchen & Dining", "Teens Rooms"],
    "Home Essentials": ["Cleaning Supplies", "Household Essentials", "Party & Occasions",
                        "Bath & Body", "Deodorants & Antiperspirants", "Feminine Care",
                        "Mens Essentials", "Oral Care", "Shaving", "Sun Care", "Hand Soaps",
                        "Bath Bombs, Bubble Baths", "College Hair Essentials", "Fragrances",
                        "ChapStick", "Beauty by Topic", "Beauty Next Day", "Beauty Stock Up",
                        "Beauty Wellness", "Cologne for Men", "All Fragrances",
                        "Perfume for Women", "Hair Care", "Here for Every Beauty",
                        "Beauty|Makeup", "Premium Beauty", "Beauty|Shop by Concern",
                        "Skin Care", "Equate|", "Family Planning", "Fiber Supplements",
                        "Sexual Wellness", "Sleep & Snoring", "Sports Medicine",
                        "Storage & Organization", "Personal Care"],
    "Maintenance-Home": ["Home Improvement", "Patio & Garden"],
    "Tools": ["Industrial"],
    "Pets": ["Pets"],
    "Sports/Outdoors": ["Sports & Outdoors"],
    "Other": ["Games & Puzzles", "Books|", "Video Games"],
    "Toys": ["Hobby &", "Arts & Crafts for Kids", "Remote Control & Play Vehicles",
             "Outdoor Play", "Kids Bikes & Riding", "Toys by Age", "Stuffed Animals",
             "Toys by Price"],
    "Vitamins/Supplements": ["Vitamins & Supplements", "Probiotics|", "Fitness|Amino",
                             "Fitness|Ancient", "Fitness|Arginine", "Fitness|BCAA",
                             "Fitness|Creatine", "Fitness|Energy", "Fitness|Fuel",
                             "Fitness|Glutamine", "Fitness|GNC", "Fitness|L-Carnitine",
                             "Fitness|Lysine", "Fitness|Muscle", "Fitness|Organic",
                             "Fitness|Optimum", "Fitness|Performance", "Fitness|Pre",
                             "Fitness|Protein Powder", "Fitness|Vegan", "Fitness|Winter",
                             "Fat Blockers", "Fat Burners", "Weight Loss Pills"],
}

# ---------------------------------------------------------------------------

# Taxonomies are parameters, joined by broadcast; this bound keeps that
# broadcast honest.  (Rule tables of any length: operators/rules.py.)
MAX_TAXONOMY = 2_000      # entries of a taxonomy (a broadcast)

TAXONOMY_SCHEMA = T.StructType([
    T.StructField("category", T.StringType(), False),
    T.StructField("cat_ord", T.IntegerType(), False),
    T.StructField("sub_category", T.StringType(), True),
    T.StructField("sub_ord", T.IntegerType(), True),
])


def taxonomy_rows(taxonomy: Mapping[str, Sequence[str]]) -> list[tuple]:
    """``(category, cat_ord, sub_category, sub_ord)``; a category with no subs
    still yields one row with null sub."""
    rows: list[tuple] = []
    for cat_ord, (category, subs) in enumerate(taxonomy.items()):
        if not subs:
            rows.append((category, cat_ord, None, None))
        for sub_ord, sub in enumerate(subs):
            rows.append((category, cat_ord, sub, sub_ord))
    if len(rows) > MAX_TAXONOMY:
        raise ValueError(f"taxonomy has {len(rows)} entries; limit is {MAX_TAXONOMY}")
    return rows


def taxonomy_df(spark: SparkSession, taxonomy: Mapping[str, Sequence[str]]) -> DataFrame:
    return spark.createDataFrame(taxonomy_rows(taxonomy), TAXONOMY_SCHEMA)


def rule_rows(rules: Mapping[str, Sequence[str]]) -> list[tuple]:
    """``(target, rule_ord, pattern)``; rule_ord is the global listing order."""
    rows: list[tuple] = []
    for target, patterns in rules.items():
        for pattern in patterns:
            rows.append((target, len(rows), pattern))
    return rows


def distinct_subs(taxonomy: Mapping[str, Sequence[str]]) -> list[str]:
    return sorted({s for subs in taxonomy.values() for s in subs})
