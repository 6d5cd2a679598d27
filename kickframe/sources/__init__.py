"""kickframe.sources"""
