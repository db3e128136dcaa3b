"""seqloom.plans"""
