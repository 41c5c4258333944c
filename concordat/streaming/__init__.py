"""concordat.streaming"""
