"""chronodex.operators"""
