"""massq.sources"""
