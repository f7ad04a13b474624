"""chronodex.sources"""
