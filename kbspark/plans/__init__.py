"""kbspark.plans"""
