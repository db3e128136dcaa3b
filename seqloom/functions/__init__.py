"""seqloom.functions"""
