"""kickframe.operators"""
