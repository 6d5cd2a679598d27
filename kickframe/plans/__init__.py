"""kickframe.plans"""
