"""kickframe.streaming"""
