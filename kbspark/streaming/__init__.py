"""kbspark.streaming"""
