"""chronodex.plans"""
