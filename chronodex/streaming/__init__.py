"""chronodex.streaming"""
