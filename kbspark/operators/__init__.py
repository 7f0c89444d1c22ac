"""kbspark.operators"""
