"""massq.functions"""
