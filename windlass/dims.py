"""Dimension tables built from literals (S7): places, features, label orders.

All are small, fixed-size tables, so broadcasting them is always safe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---- fixed values (must equal the reference's) ---------------------------------------------------
# Twenty cities by region: (region, city, latitude, longitude).
CITIES_20 = [
    ("Northeast", "New York, NY", 40.7128, -74.0060), ("Northeast", "Boston, MA", 42.3601, -71.0589),
    ("Northeast", "Philadelphia, PA", 39.9526, -75.1652), ("Northeast", "Pittsburgh, PA", 40.4406, -79.9959),
    ("Northeast", "Buffalo, NY", 42.8864, -78.8784),
    ("Southeast", "Miami, FL", 25.7617, -80.1918), ("Southeast", "Atlanta, GA", 33.7490, -84.3880),
    ("Southeast", "Charlotte, NC", 35.2271, -80.8431), ("Southeast", "Jacksonville, FL", 30.3322, -81.6557),
    ("Southeast", "Tampa, FL", 27.9506, -82.4572),
    ("Midwest", "Chicago, IL", 41.8781, -87.6298), ("Midwest", "Detroit, MI", 42.3314, -83.0458),
    ("Midwest", "Minneapolis, MN", 44.9778, -93.2650), ("Midwest", "Cleveland, OH", 41.4993, -81.6944),
    ("Midwest", "Milwaukee, WI", 43.0389, -87.9065),
    ("West", "Los Angeles, CA", 34.0522, -118.2437), ("West", "San Francisco, CA", 37.7749, -122.4194),
    ("West", "Seattle, WA", 47.6062, -122.3321), ("West", "Portland, OR", 45.5152, -122.6784),
    ("West", "Denver, CO", 39.7392, -104.9903),
]

# Eighty cities of the wind explorer: (region, city, latitude, longitude).
CITIES_80 = [
    ("Northeast", "New York, NY", 40.7128, -74.0060), ("Northeast", "Boston, MA", 42.3601, -71.0589),
    ("Northeast", "Portland, ME", 43.6591, -70.2568), ("Northeast", "Providence, RI", 41.8240, -71.4128),
    ("Northeast", "Newark, NJ", 40.7357, -74.1724), ("Northeast", "Buffalo, NY", 42.8864, -78.8784),
    ("Northeast", "Rochester, NY", 43.1566, -77.6088), ("Northeast", "Erie, PA", 42.1292, -80.0851),
    ("Northeast", "Burlington, VT", 44.4759, -73.2121), ("Northeast", "Manchester, NH", 42.9956, -71.4548),
    ("Northeast", "Montpelier, VT", 44.2601, -72.5806), ("Northeast", "Pittsburgh, PA", 40.4406, -79.9959),
    ("Northeast", "Hartford, CT", 41.7658, -72.6734), ("Northeast", "Waterbury, CT", 41.5582, -73.0515),
    ("Northeast", "Philadelphia, PA", 39.9526, -75.1652), ("Northeast", "Albany, NY", 42.6526, -73.7562),
    ("Northeast", "Syracuse, NY", 43.0481, -76.1474), ("Northeast", "Worcester, MA", 42.2626, -71.8023),
    ("Northeast", "Bridgeport, CT", 41.1865, -73.1952), ("Northeast", "Lowell, MA", 42.6334, -71.3162),
    ("Southeast", "Miami, FL", 25.7617, -80.1918), ("Southeast", "Jacksonville, FL", 30.3322, -81.6557),
    ("Southeast", "Tampa, FL", 27.9506, -82.4572), ("Southeast", "Charleston, SC", 32.7765, -79.9311),
    ("Southeast", "Savannah, GA", 32.0835, -81.0998), ("Southeast", "Nashville, TN", 36.1627, -86.7816),
    ("Southeast", "Knoxville, TN", 35.9606, -83.9207), ("Southeast", "Huntsville, AL", 34.7304, -86.5861),
    ("Southeast", "Atlanta, GA", 33.7490, -84.3880), ("Southeast", "Charlotte, NC", 35.2271, -80.8431),
    ("Southeast", "Orlando, FL", 28.5383, -81.3792), ("Southeast", "Birmingham, AL", 33.5186, -86.8104),
    ("Southeast", "Richmond, VA", 37.5407, -77.4360), ("Southeast", "Raleigh, NC", 35.7796, -78.6382),
    ("Southeast", "Greensboro, NC", 36.0726, -79.7920), ("Southeast", "Columbia, SC", 34.0007, -81.0348),
    ("Southeast", "Tallahassee, FL", 30.4518, -84.2807), ("Southeast", "Lexington, KY", 38.0406, -84.5037),
    ("Southeast", "Mobile, AL", 30.6954, -88.0399), ("Southeast", "Virginia Beach, VA", 36.8529, -75.9780),
    ("Midwest", "Chicago, IL", 41.8781, -87.6298), ("Midwest", "Detroit, MI", 42.3314, -83.0458),
    ("Midwest", "Cleveland, OH", 41.4993, -81.6944), ("Midwest", "Milwaukee, WI", 43.0389, -87.9065),
    ("Midwest", "Grand Rapids, MI", 42.9634, -85.6681), ("Midwest", "Toledo, OH", 41.6528, -83.5379),
    ("Midwest", "Kansas City, MO", 39.0997, -94.5786), ("Midwest", "Omaha, NE", 41.2565, -95.9345),
    ("Midwest", "Des Moines, IA", 41.5868, -93.6250), ("Midwest", "Wichita, KS", 37.6872, -97.3301),
    ("Midwest", "Oklahoma City, OK", 35.4676, -97.5164), ("Midwest", "Tulsa, OK", 36.1540, -95.9928),
    ("Midwest", "St. Louis, MO", 38.6270, -90.1994), ("Midwest", "Louisville, KY", 38.2527, -85.7585),
    ("Midwest", "Memphis, TN", 35.1495, -90.0490), ("Midwest", "Minneapolis, MN", 44.9778, -93.2650),
    ("Midwest", "Indianapolis, IN", 39.7684, -86.1581), ("Midwest", "Columbus, OH", 39.9612, -82.9988),
    ("Midwest", "Madison, WI", 43.0731, -89.4012), ("Midwest", "Springfield, IL", 39.7817, -89.6501),
    ("West", "Los Angeles, CA", 34.0522, -118.2437), ("West", "San Francisco, CA", 37.7749, -122.4194),
    ("West", "Seattle, WA", 47.6062, -122.3321), ("West", "Portland, OR", 45.5152, -122.6784),
    ("West", "San Diego, CA", 32.7157, -117.1611), ("West", "Denver, CO", 39.7392, -104.9903),
    ("West", "Boise, ID", 43.6150, -116.2023), ("West", "Colorado Springs, CO", 38.8339, -104.8214),
    ("West", "Reno, NV", 39.5296, -119.8138), ("West", "Spokane, WA", 47.6587, -117.4260),
    ("West", "Flagstaff, AZ", 35.1983, -111.6513), ("West", "Phoenix, AZ", 33.4484, -112.0740),
    ("West", "Las Vegas, NV", 36.1699, -115.1398), ("West", "Tucson, AZ", 32.2226, -110.9747),
    ("West", "Albuquerque, NM", 35.0844, -106.6504), ("West", "El Paso, TX", 31.7619, -106.4850),
    ("West", "Bakersfield, CA", 35.3733, -119.0187), ("West", "Fresno, CA", 36.7378, -119.7871),
    ("West", "Stockton, CA", 37.9577, -121.2908), ("West", "Modesto, CA", 37.6391, -120.9969),
]

# Geographic feature of the explorer cities; cities not listed are 'Standard'.
GEO_FEATURES = ["Coastal", "Great Lakes", "Mountain", "Desert", "Valley", "Plains", "Standard"]
GEO_FEATURE_CITIES = {
    "Coastal": ["New York, NY", "Boston, MA", "Portland, ME", "Providence, RI", "Newark, NJ",
                "Miami, FL", "Jacksonville, FL", "Tampa, FL", "Charleston, SC", "Savannah, GA",
                "Los Angeles, CA", "San Francisco, CA", "Seattle, WA", "Portland, OR", "San Diego, CA"],
    "Great Lakes": ["Buffalo, NY", "Rochester, NY", "Erie, PA", "Chicago, IL", "Detroit, MI", "Cleveland, OH",
                    "Milwaukee, WI", "Grand Rapids, MI", "Toledo, OH"],
    "Mountain": ["Burlington, VT", "Manchester, NH", "Montpelier, VT", "Denver, CO", "Boise, ID",
                 "Colorado Springs, CO", "Reno, NV", "Spokane, WA", "Flagstaff, AZ"],
    "Desert": ["Phoenix, AZ", "Las Vegas, NV", "Tucson, AZ", "Albuquerque, NM", "El Paso, TX", "Bakersfield, CA"],
    "Valley": ["Pittsburgh, PA", "Hartford, CT", "Waterbury, CT", "Nashville, TN", "Knoxville, TN",
               "Huntsville, AL", "St. Louis, MO", "Louisville, KY", "Memphis, TN", "Fresno, CA", "Stockton, CA",
               "Modesto, CA"],
    "Plains": ["Kansas City, MO", "Omaha, NE", "Des Moines, IA", "Wichita, KS", "Oklahoma City, OK", "Tulsa, OK"],
}

# One city per feature for the daily feature temperature: (feature label, latitude, longitude).
FEATURE_CITIES = [
    ("Great Lakes (Chicago, IL)", 41.8781, -87.6298), ("Coastal (Miami, FL)", 25.7617, -80.1918),
    ("Mountains (Denver, CO)", 39.7392, -104.9903), ("Desert (Phoenix, AZ)", 33.4484, -112.0740),
    ("Volcanic Islands (Honolulu, HI)", 21.3069, -157.8583), ("Appalachian (Pittsburgh, PA)", 40.4406, -79.9959),
]

# Airports of the wind-vector model: (latitude, longitude).
AIRPORTS = [(40.4406, -79.9959), (33.9425, -118.4081), (25.7959, -80.2870), (39.8617, -104.6731),
            (41.9742, -87.9073), (47.4502, -122.3088)]

# Cities of the wind-direction model: (city, latitude, longitude).
STUDY_CITIES = [("Chicago", 41.8781, -87.6298), ("Denver", 39.7392, -104.9903), ("Miami", 25.7617, -80.1918),
                ("Phoenix", 33.4484, -112.0740), ("Seattle", 47.6062, -122.3321)]
# ---------------------------------------------------------------------------------------------------

PLACE_SCHEMA = T.StructType([
    T.StructField("region", T.StringType()), T.StructField("city", T.StringType()),
    T.StructField("latitude", T.DoubleType()), T.StructField("longitude", T.DoubleType()),
])


def places(spark: SparkSession, rows=CITIES_80) -> DataFrame:
    return spark.createDataFrame(rows, PLACE_SCHEMA)


def geo_features(spark: SparkSession) -> DataFrame:
    rows = [(c, f) for f, cities in GEO_FEATURE_CITIES.items() for c in cities]
    return spark.createDataFrame(rows, "city string, feature string")


def feature_places(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FEATURE_CITIES, "feature string, latitude double, longitude double")


def airports(spark: SparkSession) -> DataFrame:
    rows = [(f"airport_{i}", lat, lon) for i, (lat, lon) in enumerate(AIRPORTS)]
    return spark.createDataFrame(rows, "place string, latitude double, longitude double")


def study_cities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STUDY_CITIES, "city string, latitude double, longitude double")


def ordered_labels(spark: SparkSession, labels: list[str], name: str = "label") -> DataFrame:
    """Small dimension giving each label its display position."""
    return spark.createDataFrame([(lab, i) for i, lab in enumerate(labels)], f"{name} string, position int")
