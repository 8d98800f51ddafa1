"""massq.streaming"""
