"""chronodex.functions"""
