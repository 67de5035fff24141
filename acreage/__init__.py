"""Acreage: property-listing analytics and price estimation as Spark DataFrame operators."""
