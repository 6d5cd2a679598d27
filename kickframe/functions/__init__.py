"""kickframe.functions"""
